"""Arguments of a command, before they become options."""

from __future__ import annotations

from collections.abc import Sequence


def preview_args(args: Sequence[str]) -> list[str]:
    """`--preview 200` and `--preview=200` become `--preview --preview-chars 200`; all others stay."""
    out: list[str] = []
    rest = iter(range(len(args)))
    for i in rest:
        word, after = args[i], args[i + 1] if i + 1 < len(args) else ""
        inline = word.removeprefix("--preview=").strip() if word.startswith("--preview=") else ""
        if word == "--preview" and _digits(after):
            out += [word, "--preview-chars", after]
            next(rest)
        elif _digits(inline):
            out += ["--preview", "--preview-chars", inline]
        else:
            out.append(word)
    return out


def _digits(text: str) -> bool:
    return text.isascii() and text.isdigit()


def preview_mode(args: Sequence[str]) -> str:
    """enabled, disabled or unset, by the first argument that says so."""
    for word in args:
        if word in ("--no-preview", "--preview=false"):
            return "disabled"
        if word == "--preview" or word.startswith("--preview="):
            return "enabled"
    return "unset"


def integer_option(value, flag: str, least: int) -> int | None:
    """A whole number of at least `least`; None passes, anything else is an error."""
    if value is None:
        return None
    whole = not isinstance(value, bool) and isinstance(value, (int, float)) and value == value and abs(value) != float("inf") and value == int(value)
    if not whole or value < least:
        raise ValueError(f"{flag}: a whole number from {least} on, not {value!r}")
    return int(value)
