"""Word and slide files by the standard library (SK5-SK14).

Rows of a document are gathered by its key, one document at a time in a task; a document is bounded
by what a person can open.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame

EMU = 12_700
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
DRAW = "http://schemas.openxmlformats.org/drawingml/2006/main"
SLIDE = "http://schemas.openxmlformats.org/presentationml/2006/main"
TYPE = "application/vnd.openxmlformats-officedocument."
#: Points from the edge of a slide to its text, and its size in points.
SLIDE_W, SLIDE_H = 960, 540


def plain(text: str) -> str:
    """Text as XML can hold it: escaped, without control characters but tab (SK7, P13)."""
    return escape(re.sub(r"[\x00-\x08\x0B-\x1F\uFFFE\uFFFF]", "", text))


def archive(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def types(overrides: dict[str, str]) -> str:
    rows = "".join(f'<Override PartName="/{n}" ContentType="{TYPE}{t}+xml"/>' for n, t in overrides.items())
    return f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/>{rows}</Types>'


def relations(rows: list[tuple[str, str, str]]) -> str:
    body = "".join(f'<Relationship Id="{i}" Type="{OFFICE}/{t}" Target="{target}"/>' for i, t, target in rows)
    return f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">{body}</Relationships>'


def word_runs(text: str, flags: int = 0, size: float | None = None, color: int | None = None) -> str:
    """Runs of a paragraph; breaks within it stay."""
    style = ("<w:b/>" if flags & 16 else "") + ("<w:i/>" if flags & 2 else "")
    style += f'<w:color w:val="{color:06X}"/>' if color is not None else ""
    style += f'<w:sz w:val="{round(size * 2)}"/>' if size else ""
    style = f"<w:rPr>{style}</w:rPr>" if style else ""
    parts = [f'<w:r>{style}<w:t xml:space="preserve">{plain(t)}</w:t></w:r>' for t in text.split("\n")]
    return "<w:r><w:br/></w:r>".join(parts)


def word_paragraph(text: str, level: int | None = None, **style) -> str:
    props = f'<w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr>' if level else ""
    return f"<w:p>{props}{word_runs(text, **style)}</w:p>"


def word_file(paragraphs: list[str]) -> bytes:
    """A file of letter size (612 x 792 points) from paragraphs' XML."""
    page = '<w:sectPr><w:pgSz w:w="12240" w:h="15840"/></w:sectPr>'
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{n}"><w:name w:val="heading {n}"/><w:rPr><w:b/><w:sz w:val="32"/></w:rPr></w:style>' for n in (1, 2, 3))
    return archive({
        "[Content_Types].xml": types({"word/document.xml": "wordprocessingml.document.main", "word/styles.xml": "wordprocessingml.styles"}),
        "_rels/.rels": relations([("rId1", "officeDocument", "word/document.xml")]),
        "word/_rels/document.xml.rels": relations([("rId1", "styles", "styles.xml")]),
        "word/styles.xml": f'{HEAD}<w:styles xmlns:w="{WORD}">{styles}</w:styles>',
        "word/document.xml": f'{HEAD}<w:document xmlns:w="{WORD}"><w:body>{"".join(paragraphs)}{page}</w:body></w:document>',
    })


def text_box(n: int, x: float, y: float, w: float, h: float, lines: list[str], size: float, bold: bool = False, italic: bool = False, color: int = 0x25314D, font: str | None = None, spacing: float = 0.0, align: str = "l") -> str:
    """A box in points; lines are soft breaks of one paragraph."""
    face = f"<a:latin typeface={quoteattr(font)}/><a:ea typeface={quoteattr(font)}/>" if font else ""
    props = f'<a:rPr lang="en-US" sz="{round(size * 100)}" b="{int(bold)}" i="{int(italic)}" spc="{round(spacing * 100)}"><a:solidFill><a:srgbClr val="{color:06X}"/></a:solidFill>{face}</a:rPr>'
    runs = "<a:br/>".join(f"<a:r>{props}<a:t>{plain(t)}</a:t></a:r>" for t in lines)
    place = f'<a:xfrm><a:off x="{round(x * EMU)}" y="{round(y * EMU)}"/><a:ext cx="{round(w * EMU)}" cy="{round(h * EMU)}"/></a:xfrm>'
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{n + 1}" name="Text {n}"/><p:cNvSpPr txBox="1"/><p:nvPr/></p:nvSpPr><p:spPr>{place}<a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr><p:txBody><a:bodyPr wrap="none"/><a:p><a:pPr algn="{align}"/>{runs}</a:p></p:txBody></p:sp>'


def shape(n: int, kind: str, x0: float, y0: float, x1: float, y1: float, fill: int | None, line: int | None) -> str:
    """A rectangle, ellipse or line in points; null colours are none."""
    paint = lambda c: f'<a:solidFill><a:srgbClr val="{c:06X}"/></a:solidFill>' if c is not None else "<a:noFill/>"
    name = {"rect": "rect", "ellipse": "ellipse", "line": "line"}[kind]
    place = f'<a:xfrm><a:off x="{round(x0 * EMU)}" y="{round(y0 * EMU)}"/><a:ext cx="{round((x1 - x0) * EMU)}" cy="{round((y1 - y0) * EMU)}"/></a:xfrm>'
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{n + 1}" name="Shape {n}"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr>{place}<a:prstGeom prst="{name}"><a:avLst/></a:prstGeom>{paint(fill)}<a:ln>{paint(line)}</a:ln></p:spPr></p:sp>'


def picture(n: int, rel: str, x0: float, y0: float, x1: float, y1: float) -> str:
    place = f'<a:xfrm><a:off x="{round(x0 * EMU)}" y="{round(y0 * EMU)}"/><a:ext cx="{round((x1 - x0) * EMU)}" cy="{round((y1 - y0) * EMU)}"/></a:xfrm>'
    return f'<p:pic><p:nvPicPr><p:cNvPr id="{n + 1}" name="Picture {n}"/><p:cNvPicPr/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="{rel}"/><a:stretch><a:fillRect/></a:stretch></p:blipFill><p:spPr>{place}<a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr></p:pic>'


GROUP = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
SPACES = f'xmlns:a="{DRAW}" xmlns:r="{OFFICE}" xmlns:p="{SLIDE}"'


def slide_file(slides: list[str], width: float = SLIDE_W, height: float = SLIDE_H, media: list[dict[str, bytes]] | None = None) -> bytes:
    """A file of slides from their shapes' XML; media: for each slide its pictures by relation."""
    media = media or [{}] * len(slides)
    parts: dict[str, str | bytes] = {}
    over = {"ppt/presentation.xml": "presentationml.presentation.main", "ppt/slideMasters/slideMaster1.xml": "presentationml.slideMaster", "ppt/slideLayouts/slideLayout1.xml": "presentationml.slideLayout", "ppt/theme/theme1.xml": "theme"}
    for i, (xml, own) in enumerate(zip(slides, media, strict=True), 1):
        over[f"ppt/slides/slide{i}.xml"] = "presentationml.slide"
        parts[f"ppt/slides/slide{i}.xml"] = f"{HEAD}<p:sld {SPACES}><p:cSld><p:spTree>{GROUP}{xml}</p:spTree></p:cSld></p:sld>"
        rows = [("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml")]
        for rel, data in own.items():
            parts[f"ppt/media/{i}-{rel}.png"] = data
            rows.append((rel, "image", f"../media/{i}-{rel}.png"))
        parts[f"ppt/slides/_rels/slide{i}.xml.rels"] = relations(rows)
    ids = "".join(f'<p:sldId id="{255 + i}" r:id="rId{i + 1}"/>' for i in range(1, len(slides) + 1))
    deck = [("rId1", "slideMaster", "slideMasters/slideMaster1.xml")] + [(f"rId{i + 1}", "slide", f"slides/slide{i}.xml") for i in range(1, len(slides) + 1)]
    empty = f"<p:cSld><p:spTree>{GROUP}</p:spTree></p:cSld>"
    roles = 'bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" accent1="accent1" accent2="accent2" accent3="accent3" accent4="accent4" accent5="accent5" accent6="accent6" hlink="hlink" folHlink="folHlink"'
    colours = "".join(f'<a:{n}><a:srgbClr val="{v}"/></a:{n}>' for n, v in [("dk1", "000000"), ("lt1", "FFFFFF"), ("dk2", "25314D"), ("lt2", "EEEEEE"), *[(f"accent{i}", "4472C4") for i in range(1, 7)], ("hlink", "0563C1"), ("folHlink", "954F72")])
    fonts = "".join(f'<a:{n}Font><a:latin typeface="Arial"/><a:ea typeface=""/><a:cs typeface=""/></a:{n}Font>' for n in ("major", "minor"))
    fill, line, effect = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>', '<a:ln><a:solidFill><a:schemeClr val="phClr"/></a:solidFill></a:ln>', "<a:effectStyle><a:effectLst/></a:effectStyle>"
    return archive({
        "[Content_Types].xml": types(over),
        "_rels/.rels": relations([("rId1", "officeDocument", "ppt/presentation.xml")]),
        "ppt/presentation.xml": f'{HEAD}<p:presentation {SPACES}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="{round(width * EMU)}" cy="{round(height * EMU)}"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": relations(deck),
        "ppt/slideMasters/slideMaster1.xml": f'{HEAD}<p:sldMaster {SPACES}>{empty}<p:clrMap {roles}/><p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst></p:sldMaster>',
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": relations([("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml"), ("rId2", "theme", "../theme/theme1.xml")]),
        "ppt/slideLayouts/slideLayout1.xml": f"{HEAD}<p:sldLayout {SPACES}>{empty}</p:sldLayout>",
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": relations([("rId1", "slideMaster", "../slideMasters/slideMaster1.xml")]),
        "ppt/theme/theme1.xml": f'{HEAD}<a:theme xmlns:a="{DRAW}" name="plain"><a:themeElements><a:clrScheme name="plain">{colours}</a:clrScheme><a:fontScheme name="plain">{fonts}</a:fontScheme><a:fmtScheme name="plain"><a:fillStyleLst>{fill * 3}</a:fillStyleLst><a:lnStyleLst>{line * 3}</a:lnStyleLst><a:effectStyleLst>{effect * 3}</a:effectStyleLst><a:bgFillStyleLst>{fill * 3}</a:bgFillStyleLst></a:fmtScheme></a:themeElements></a:theme>',
        **parts,
    })


def kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def word_documents(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, content: a Word file of each document's lines (line_no, text, level: 1 to 3 or null) (SK7)."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("line_no")
        xml = [word_paragraph(t, None if pd.isna(v) else int(v)) for t, v in zip(part["text"], part["level"], strict=True)]
        return pd.DataFrame({doc: [part[doc].iloc[0]], "content": [word_file(xml)]})

    return rows.groupBy(doc).applyInPandas(work, f"{kinds(rows, [doc])}, content binary")


def slide_documents(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, content: slides of each document's lines (slide, line_no, title, text) (SK8)."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        slides = []
        for _, own in part.sort_values(["slide", "line_no"]).groupby("slide", sort=True):
            body = "".join(text_box(k + 2, 39.6, 86.4 + 30 * k, 878, 26, [t], 20, font="Microsoft YaHei") for k, t in enumerate(own["text"]))
            slides.append(text_box(1, 39.6, 25.2, 878, 43, [own["title"].iloc[0]], 24, font="Microsoft YaHei") + body)
        return pd.DataFrame({doc: [part[doc].iloc[0]], "content": [slide_file(slides)]})

    return rows.groupBy(doc).applyInPandas(work, f"{kinds(rows, [doc])}, content binary")


def layout_slides(objects: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, content: slides of pages' objects in their order (SK9, SK11-SK13).

    objects: doc, page, width, height, seq, kind (text, shape, image), x0 to y1, and of texts text,
    size, flags, color, font, spacing; of shapes geometry, fill, line; of images data. The first page
    gives the slide's size; others are scaled to fit and centred.
    """

    def work(part: pd.DataFrame) -> pd.DataFrame:
        pages = list(part.sort_values(["page", "seq"]).groupby("page", sort=True))
        width, height = (float(pages[0][1][c].iloc[0]) for c in ("width", "height"))
        none = lambda v: None if pd.isna(v) else int(v)
        slides, media = [], []
        for _, own in pages:
            w, h = float(own["width"].iloc[0]), float(own["height"].iloc[0])
            k = min(width / w, height / h)
            dx, dy = (width - w * k) / 2, (height - h * k) / 2
            xml, files = [], {}
            for n, o in enumerate(own.itertuples(), 1):
                x0, y0, x1, y1 = o.x0 * k + dx, o.y0 * k + dy, o.x1 * k + dx, o.y1 * k + dy
                if o.kind == "text":
                    xml.append(text_box(n, x0, y0, x1 - x0, y1 - y0, o.text.split("\n"), o.size * k, bool(int(o.flags) & 16), bool(int(o.flags) & 2), int(o.color), o.font, 0.0 if pd.isna(o.spacing) else o.spacing * k))
                elif o.kind == "shape":
                    xml.append(shape(n, o.geometry, x0, y0, x1, y1, none(o.fill), none(o.line)))
                else:
                    files[f"rId{n + 1}"] = bytes(o.data)
                    xml.append(picture(n, f"rId{n + 1}", x0, y0, x1, y1))
            slides.append("".join(xml))
            media.append(files)
        return pd.DataFrame({doc: [part[doc].iloc[0]], "content": [slide_file(slides, width, height, media)]})

    return objects.groupBy(doc).applyInPandas(work, f"{kinds(objects, [doc])}, content binary")
