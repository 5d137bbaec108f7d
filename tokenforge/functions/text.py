"""String column functions with Python's semantics where the reference relies on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes (str.isspace()).
PY_WHITESPACE = (r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                 r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
_WS = f"[{PY_WHITESPACE}]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(text) -> Column:
    """``str.strip()`` with Python's whitespace set (C9); SQL ``trim`` strips spaces only."""
    return F.regexp_replace(_c(text), f"^{_WS}+|{_WS}+$", "")


def ensure_suffix(text, suffix: str = "\n\n") -> Column:
    """Append ``suffix`` unless the text already ends with it."""
    t = _c(text)
    return F.when(t.endswith(suffix), t).otherwise(F.concat(t, F.lit(suffix)))


def refine_context(text) -> Column:
    """Context cleanup (C8): strip, split lines, strip each line, drop blank
    lines, join with newlines, strip, prefix a newline.

    Python's ``str.strip()`` already removes U+3000 and CR, so the reference's
    extra ``strip('\u3000').strip('\r')`` per line changes nothing after it.
    """
    lines = F.transform(F.split(strip_ws(text), "\n"), lambda l: strip_ws(l))
    kept = F.filter(lines, lambda l: l != "")
    return F.concat(F.lit("\n"), strip_ws(F.array_join(kept, "\n")))


def cut_at_stop(text, stop: str) -> Column:
    """Generated text cut before the first stop string (C17)."""
    return F.substring_index(_c(text), stop, 1)


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """``template.format(**values)``: ``{name}`` placeholders, ``{{``/``}}`` literal.

    The template is split at the placeholders on the driver (it is a constant),
    so the row-level work is one ``concat``.
    """
    import re
    parts: list[Column] = []
    pos = 0
    for m in re.finditer(r"\{\{|\}\}|\{([A-Za-z_][A-Za-z0-9_]*)\}", template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        tok = m.group(0)
        if tok == "{{":
            parts.append(F.lit("{"))
        elif tok == "}}":
            parts.append(F.lit("}"))
        else:
            name = m.group(1)
            if name not in values:
                raise KeyError(name)
            parts.append(values[name].cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")
