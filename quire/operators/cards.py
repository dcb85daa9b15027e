"""Flash cards in Markdown: parsing, policy and canonical rendering.

The grammar is the observable part of the card format: `## ` opens a card, `***` on its own line parts a front body
from the back, code fences suspend both, a `# ` heading is a stray one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.ordering import numbered

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
_BULLET = re.compile(r"[-*+][ \t]+\S")
_EMPTY_BULLET = re.compile(r"[-*+][ \t]*")


def in_code(lines: list[str]) -> list[bool]:
    """Whether each line is part of a fenced block, its fences included."""
    out, fence = [], ""
    for line in lines:
        m = _FENCE.fullmatch(line)
        if fence:
            out.append(True)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
        else:
            opens = bool(m) and not (m[1][0] == "`" and "`" in m[2])
            out.append(opens)
            fence = m[1] if opens else ""
    return out


def _body(lines: list[str]) -> str:
    return "\n".join(lines).strip("\n")


def parse(markdown: str | None) -> dict:
    """cards, preamble and diagnostics of one document."""
    lines = re.split(r"\r\n|\r|\n", markdown or "")
    code = in_code(lines)
    cards: list[dict] = []
    diagnostics: list[tuple[str, str]] = []
    preamble: list[str] = []
    block: list[str] | None = preamble
    heads: list[tuple[str, list[tuple[str, bool]]]] = []
    for n, (line, fenced) in enumerate(zip(lines, code), 1):
        if not fenced and re.match(r"## |##$", line):
            heads.append((line[2:].strip(), []))
            block = None
        elif not fenced and re.match(r"# ", line):
            diagnostics.append(("stray-h1", f"Heading of level 1 on line {n}"))
        elif block is None:
            heads[-1][1].append((line, fenced))
        else:
            block.append(line)
    for title, body in heads:
        if not title:
            diagnostics.append(("malformed-card-skipped", "A card has an empty front"))
            continue
        at = next((i for i, (x, fenced) in enumerate(body) if not fenced and x.rstrip() == "***"), None)
        texts = [x for x, _ in body]
        cards.append({"heading_text": title, "front_body": "" if at is None else _body(texts[:at]), "back": _body(texts if at is None else texts[at + 1 :]), "has_separator": at is not None})
    head = _body(preamble)
    return {"cards": cards, "preamble": head if head.strip() else None, "diagnostics": diagnostics}


def has_bullet(body: str) -> bool:
    lines = body.split("\n")
    return any(not c and _BULLET.match(x) for x, c in zip(lines, in_code(lines)))


def issues(markdown: str | None) -> list[dict]:
    """All that is wrong with an answer, in order: grammar, bullets, empty bullets, repeated fronts, preamble, no cards."""
    found = parse(markdown)
    out = [{"message": f"{code}: {text}", "lines": []} for code, text in found["diagnostics"]]
    out += [{"message": f'Card "{c["heading_text"]}" is missing bullet items', "lines": []} for c in found["cards"] if not has_bullet(c["front_body"]) and not has_bullet(c["back"])]
    lines = re.split(r"\r\n|\r|\n", markdown or "")
    out += [{"message": "Empty bullet item", "lines": [n]} for n, (x, c) in enumerate(zip(lines, in_code(lines)), 1) if not c and _EMPTY_BULLET.fullmatch(x)]
    seen: set[str] = set()
    for c in found["cards"]:
        if c["heading_text"] in seen:
            out.append({"message": f'Duplicate card front "{c["heading_text"]}"', "lines": []})
        seen.add(c["heading_text"])
    if found["preamble"] is not None:
        out.append({"message": "Content found before the first card front", "lines": []})
    if not found["cards"]:
        out.append({"message": 'No flashcards detected (expected lines starting with "## ")', "lines": []})
    return out


def report(found: list[dict]) -> str:
    lines = [f"{i}. {x['message']}" + (f" (lines {', '.join(map(str, x['lines']))})" if x["lines"] else "") for i, x in enumerate(found, 1)]
    return "Markdown validation failed:\n" + "\n".join(lines)


def read_answer(markdown: str | None) -> list[dict]:
    """Cards of a valid answer; raises with all issues of any other."""
    found = issues(markdown)
    if found:
        raise ValueError(report(found))
    return parse(markdown)["cards"]


def render_card(card: dict) -> str:
    """Canonical form: a blank line after the heading and around the separator."""
    parts = [f"## {card['heading_text']}"]
    if card.get("has_separator"):
        parts += [x for x in (card.get("front_body"), "***") if x]
    if card.get("back"):
        parts.append(card["back"])
    return "\n\n".join(parts)


CARD_ROWS = "book_id string, section_index int, card_ord int, heading_text string, front_body string, back string, has_separator boolean"
ISSUE_ROWS = "book_id string, section_index int, ord int, message string, lines array<int>"


def card_table(answers: DataFrame) -> DataFrame:
    """answers (book_id, section_index, markdown) as cards; answers with issues give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for b, s, m in zip(f["book_id"], f["section_index"], f["markdown"]):
                if not issues(m):
                    rows += [{"book_id": b, "section_index": s, "card_ord": i, **c} for i, c in enumerate(parse(m)["cards"], 1)]
            yield pd.DataFrame(rows, columns=["book_id", "section_index", "card_ord", "heading_text", "front_body", "back", "has_separator"])

    return answers.select("book_id", "section_index", "markdown").mapInPandas(run, CARD_ROWS)


def issue_table(answers: DataFrame) -> DataFrame:
    """answers as issues, in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"book_id": b, "section_index": s, "ord": i, **x} for b, s, m in zip(f["book_id"], f["section_index"], f["markdown"]) for i, x in enumerate(issues(m), 1)]
            yield pd.DataFrame(rows, columns=["book_id", "section_index", "ord", "message", "lines"])

    return answers.select("book_id", "section_index", "markdown").mapInPandas(run, ISSUE_ROWS)


def rendered(front: Column, front_body: Column, back: Column, separator: Column) -> Column:
    """render_card as a Column."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws("\n\n", F.concat(F.lit("## "), front), F.when(separator, blank(front_body)), F.when(separator, F.lit("***")), blank(back))


def duplicate_fronts(cards: DataFrame) -> DataFrame:
    """The second and later cards of a section with the same front, in the relational form of the policy."""
    w = Window.partitionBy("book_id", "section_index", "heading_text").orderBy("card_ord")
    return cards.where(F.coalesce("heading_text", F.lit("")) != "").withColumn("__n", F.row_number().over(w)).where("__n > 1").drop("__n")


def deck_markdown(cards: DataFrame, title: str = "Deck") -> DataFrame:
    """One row a book: the deck's title and all cards in order, canonical."""
    text = rendered(F.col("heading_text"), F.col("front_body"), F.col("back"), F.col("has_separator"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_index", "card_ord", text.alias("t")))), lambda x: x["t"]), "\n\n")
    return cards.groupBy("book_id").agg(F.concat(F.lit(f"# {title.strip() or 'Deck'}\n\n"), body, F.lit("\n")).alias("markdown"), F.count(F.lit(1)).alias("cards"))


def number_cards(cards: DataFrame, parts: int | None = None) -> DataFrame:
    """All cards of all books in one order, by book, section and place in it, with their place n from 1: what a run over all books would have gathered."""
    return numbered(cards, "book_id", "section_index", "card_ord", parts=parts)
