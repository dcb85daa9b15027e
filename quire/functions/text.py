"""Text functions as Columns. White space, lengths and `$` follow the rules of ECMAScript strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of ECMAScript, as a Java character class. U+0085 is not in it, U+FEFF is.
JS_WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# The same class for regular expressions of the RE2 kind.
RE2_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
PREVIEW_CHARS = 120
ERROR_CHARS = 2000


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{JS_WS}+|{JS_WS}+\\z", "")


def js_trim_end(c: Column) -> Column:
    return F.regexp_replace(c, f"{JS_WS}+\\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(c, f"{JS_WS}+", " ")


def utf16_len(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def utf16_left(c: Column, n: int) -> Column:
    """The first n UTF-16 code units; a pair that the cut would split is left out."""
    cut = F.substring(F.encode(c, "UTF-16BE"), 1, 2 * n)
    high = F.substring(cut, 2 * n - 1, 1)
    split = (F.octet_length(cut) == 2 * n) & (F.hex(high) >= "D8") & (F.hex(high) <= "DB")
    return F.when(utf16_len(c) <= n, c).otherwise(F.decode(F.when(split, F.substring(cut, 1, 2 * n - 2)).otherwise(cut), "UTF-16BE"))


def clean_text(c: Column) -> Column:
    """Null becomes empty; NUL and CR go (and glue what they parted); white space collapses; ends are trimmed."""
    bare = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\0"), F.lit("")), F.lit("\r"), F.lit(""))
    return js_trim(collapse(bare))


# Entities that are decoded, in this order, so that &amp;lt; ends as <.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]


def clean_html(c: Column) -> Column:
    """Text of HTML: scripts and styles on one line go, then all tags, without a space in their place."""
    out = F.coalesce(c, F.lit(""))
    for tag in ("script", "style"):
        out = F.regexp_replace(out, f"(?iu)<{tag}[^>]*>.*?</{tag}>", "")
    out = F.regexp_replace(out, "<[^>]*>", "")
    for name, value in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(value))
    return js_trim(collapse(out))


def preview(c: Column, n: int = PREVIEW_CHARS) -> Column:
    n = n if isinstance(n, int) and n > 0 else PREVIEW_CHARS
    text = js_trim(collapse(F.coalesce(c, F.lit(""))))
    return F.when(text == "", "[empty]").when(utf16_len(text) <= n, text).otherwise(F.concat(js_trim_end(utf16_left(text, n)), F.lit("...")))


def kebab(c: Column, empty: str = "deck") -> Column:
    out = F.regexp_replace(F.lower(js_trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(out, "^-+|-+\\z", ""), F.lit("")), F.lit(empty))


def path_arg(c: Column) -> Column:
    """Trimmed, or null if blank."""
    return F.nullif(js_trim(c), F.lit(""))


def first_non_blank(*cols: Column) -> Column:
    """The first that is not blank, untrimmed."""
    return F.coalesce(*[F.when(js_trim(c) != "", c) for c in cols])


def file_stem(name: Column, extension: str) -> Column:
    """The name without the first occurrence of the extension, case-sensitive."""
    at = F.locate(extension, name)
    return F.when(at > 0, F.concat(F.substring(name, F.lit(1), at - 1), F.substring(name, at + len(extension), F.length(name)))).otherwise(name)


def redact(c: Column) -> Column:
    """Bearer tokens, key-like strings and key assignments lose their secret."""
    out = F.regexp_replace(c, f"(?i)(Bearer{JS_WS}+)[A-Za-z0-9._-]+", "$1[redacted]")
    out = F.regexp_replace(out, r"\bsk-[A-Za-z0-9_-]{12,}\b", "[redacted-api-key]")
    return F.regexp_replace(out, r"(?i)((?:CODEX|OPENAI)_API_KEY=)[^" + JS_WS[1:-1] + "]+", "$1[redacted]")


def error_output(c: Column) -> Column:
    out = js_trim(redact(F.coalesce(c, F.lit(""))))
    return F.when(utf16_len(out) > ERROR_CHARS, F.concat(utf16_left(out, ERROR_CHARS), F.lit("..."))).otherwise(out)


def uri_decode(c: Column) -> Column:
    """Percent-decoding that leaves plus signs alone."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def url_extension(c: Column) -> Column:
    """Extension of a URL's path, with its dot; query and fragment do not count."""
    return F.regexp_extract(F.coalesce(F.parse_url(c, F.lit("PATH")), F.lit("")), r"(?<=[^/])(\.[^./]*)$", 1)


def describe_error(message: Column) -> Column:
    return F.coalesce(message, F.lit("unknown error"))


def retry_log_line(label: Column, message: Column) -> Column:
    """One short line from a client library's retry message; null for other messages."""
    left = F.regexp_extract(message, r"retrying, (\d+) attempts? remaining", 1)
    status = F.nullif(F.regexp_extract(message, r"with status (\d+)", 1), F.lit(""))
    broken = F.nullif(F.regexp_extract(message, r"connection (timed out|failed)", 0), F.lit(""))
    return F.when(left != "", F.concat(label, F.lit(": "), F.coalesce(status, broken, F.lit("error")), F.lit(", retrying ("), left, F.lit(" left)")))


def answer_text(content: Column) -> Column:
    """Text of a chat answer's content, given as JSON: a string, or an array of parts of which those of type text count."""
    plain = F.when(F.substring(js_trim(content), 1, 1) == '"', F.nullif(js_trim(F.from_json(F.concat(F.lit('{"s":'), content, F.lit("}")), "s string")["s"]), F.lit("")))
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.filter(F.transform(F.filter(parts, lambda x: (x["type"] == "text") & x["text"].isNotNull()), lambda x: js_trim(x["text"])), lambda t: t != "")
    return F.coalesce(plain, F.when(F.size(texts) > 0, F.array_join(texts, "\n")))


def exec_prompt(prompt: Column, content: Column, head: tuple[str, ...]) -> Column:
    """What a command-line model reads: the caller's head lines, the prompt and a section's text."""
    return F.concat_ws("\n", *[F.lit(x) for x in head], F.lit(""), F.lit("Prompt:"), js_trim(prompt), F.lit(""), F.lit("Source text:"), js_trim(content))


def profile(c: Column) -> Column:
    """A trimmed profile name, null if blank; raises for other characters than letters, digits, dash and underscore."""
    p = js_trim(c)
    return F.when(p.rlike(r"^[A-Za-z0-9_-]+\z"), p).when(p == "", F.lit(None)).otherwise(F.when(p.isNotNull(), F.raise_error(F.lit("a profile has letters, digits, hyphens and underscores only")).cast("string")))


def effort(c: Column) -> Column:
    """A reasoning effort in small letters, null stays; raises for anything but low, medium and high."""
    e = F.lower(js_trim(c))
    return F.when(e.isin("low", "medium", "high"), e).otherwise(F.when(c.isNotNull(), F.raise_error(F.concat(F.lit("no reasoning effort: "), c)).cast("string")))


def prompt_name(c: Column) -> Column:
    """A prompt's name without .md, or null if it has other characters than letters, digits, dot, dash, underscore."""
    name = F.regexp_replace(js_trim(c), r"(?i)\.md\z", "")
    return F.when(name.rlike(r"^[a-zA-Z0-9._-]+\z"), name)


def env_var(provider: Column) -> Column:
    return F.concat(F.upper(provider), F.lit("_API_KEY"))


def language(name: Column, aliases: dict[str, str]) -> Column:
    """A code block's language under its full name; unknown names stay."""
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)


# Short names of languages on a fence.
LANGUAGE_ALIASES = {
    "c#": "csharp", "c++": "cpp", "html": "markup", "js": "javascript", "md": "markdown", "py": "python",
    "rb": "ruby", "rs": "rust", "sh": "bash", "shell": "bash", "ts": "typescript", "yml": "yaml",
}


def java_regex(pattern: str, flags: str | None = "i") -> str | None:
    """An ECMAScript pattern for rlike, or None if it does not compile.

    `$` without the flag m only matches at the very end. The flags g and y, which make a matcher remember where it
    stopped, are ignored.
    """
    flags = "i" if flags is None else flags
    if set(flags) - set("dgimsuvy"):
        return None
    try:
        re.compile(re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", pattern))
    except re.error:
        return None
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            pair = pattern[i : i + 2]
            out.append({r"\s": JS_WS if not in_class else JS_WS[1:-1]}.get(pair, pair))
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]":
            in_class = False
        out.append(r"\z" if ch == "$" and not in_class and "m" not in flags else ch)
        i += 1
    mode = "".join(x for x in "ims" if x in flags)
    return (f"(?{mode}{'u' if 'i' in mode else ''})" if mode else "") + "".join(out)
