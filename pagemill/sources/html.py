"""Text of HTML by expressions (SC3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import clean, strip

HIDDEN = ("script", "style", "head", "template", "noscript")
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tr|ul"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"), ("&amp;", "&")]


def markdown(html: Column) -> Column:
    """Markdown-like text: headings with signs, items with a hyphen, blocks on lines of their own; null stays."""
    x = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in HIDDEN:
        x = F.regexp_replace(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    x = F.regexp_replace(x, r"\s+", " ")
    for n in range(1, 7):
        x = F.regexp_replace(x, rf"(?i)<h{n}\b[^>]*>", "\n" + "#" * n + " ")
    x = F.regexp_replace(x, r"(?i)<li\b[^>]*>", "\n- ")
    x = F.regexp_replace(x, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for name, char in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(char))
    x = F.regexp_replace(x, r"[ \t]*\n[ \t]*", "\n")
    return strip(clean(F.regexp_replace(F.regexp_replace(x, r" {2,}", " "), r"\n{2,}", "\n")))
