"""HTML to text (S4a visible text, S4b tag stripping).

S4b is three JVM regex replacements.  S4a tokenises the markup with JVM
regexes (non-text nodes become a node separator), decodes character
references in one Arrow-batched pandas UDF (``html.unescape``), and does
the strip / drop-blank / join in JVM higher-order functions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docweave.functions.text import strip_ws

SEP = "\u0001"  # text-node separator; never produced by entity decoding

# Elements whose text is not visible text.  script/style hold raw text (no
# tags inside); template/rt/rp hold markup whose strings are not page text.
_RAW_BLOCK = r"<(script|style)\b[^>]*>[\s\S]*?(?:</\1\s*>|\z)"
_COMMENT = r"<!--[\s\S]*?(?:-->|\z)"
_CDATA = r"<!\[CDATA\[([\s\S]*?)\]\]>"
_DECL = r"<[!?][^>]*>"
# start/end tags; attribute values may be quoted and hold '>'
# possessive: no backtracking, and the group repeats per run (not per
# character), so long attribute values cannot exhaust the regex stack
_TAG = r"</?[A-Za-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
_WS = r"[\s\x1c-\x1f]"
_ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_STACKED = "template|rt|rp|ruby"
_STACKED_TAG = rf"(?iu)<(/?)({_STACKED})\b{_ATTRIBUTES}>"
_EMPTY_TAG = rf"(?iu)<(?:{_STACKED})(?:[\s/]{_ATTRIBUTES})?(?<=/)>"
# group 2: the text of a CDATA section; group 3: a tag that shows or hides text
_NODE = (rf"(?iu)(?:{_COMMENT}|{_RAW_BLOCK}|{_CDATA}|{_DECL}"
         rf"|(</?(?:{_STACKED})\b{_ATTRIBUTES}>)|{_TAG})")
OPEN, SHUT = "\u0002", "\u0003"  # around the names of stacked tags


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def html_strip_tags(c) -> Column:
    """Delete script blocks, style blocks, then every tag.

    No entity decoding; whitespace kept as is.
    """
    x = F.regexp_replace(_c(c), r"(?iu)<script[\s\S]*?</script>", "")
    x = F.regexp_replace(x, r"(?iu)<style[\s\S]*?</style>", "")
    return F.regexp_replace(x, r"<[^>]+>", "")


def mark_text_nodes(c) -> Column:
    """Replace every non-text node with the separator (JVM only).

    One pass, leftmost first, so what a comment, a raw block or an attribute
    value holds is never read as markup.  Only the tags of hidden elements
    and of ruby survive it, as marks, for ``shown``."""
    x = F.replace(F.replace(_c(c), F.lit(OPEN), F.lit("")), F.lit(SHUT), F.lit(""))
    x = F.regexp_replace(x, _NODE, SEP + "$2$3" + SEP)
    x = F.regexp_replace(x, _EMPTY_TAG, SEP)
    return F.regexp_replace(x, _STACKED_TAG, f"{OPEN}$1$2{SHUT}")


def shown(v):
    """Marked text less what template, rt and rp hold, at any depth.  An end tag
    closes the latest open element of its name and all that is open inside it
    (so ``</ruby>`` ends an open rt or rp); without one it is ignored."""
    if not isinstance(v, str) or OPEN not in v:
        return v
    head, *rest = v.split(OPEN)
    out, stack, held, hiding = [head], [], dict.fromkeys(_STACKED.split("|"), 0), 0
    for piece in rest:
        name, _, text = piece.partition(SHUT)
        name = name.lower()
        if name[0] != "/":
            stack.append(name)
            held[name] += 1
            hiding += name != "ruby"
        elif held[name[1:]]:
            top = None
            while top != name[1:]:
                top = stack.pop()
                held[top] -= 1
                hiding -= top != "ruby"
        out.append("" if hiding else text)
    return SEP.join(out)


def unescape_one(v):
    import html

    return html.unescape(v) if isinstance(v, str) and "&" in v else v


@F.pandas_udf(StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """Drop hidden elements, then decode named and numeric character references (HTML5 rules)."""
    return s.map(lambda v: unescape_one(shown(v)))


def join_text_nodes(marked) -> Column:
    """Strip each node, drop blank ones, join with newlines."""
    nodes = F.split(_c(marked), SEP)
    stripped = F.transform(nodes, strip_ws)
    return F.array_join(F.filter(stripped, lambda n: n != ""), "\n")


def html_visible_text(c) -> Column:
    """Visible text nodes, each stripped, blanks dropped, newline-joined.

    Entities are decoded after tag removal (so ``&lt;`` never becomes a tag)
    and before stripping (so ``&nbsp;`` is stripped).
    """
    return join_text_nodes(html_unescape(mark_text_nodes(c)))
