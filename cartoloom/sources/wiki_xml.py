"""Pages of encyclopedia dumps in XML, single files or multistream files with their index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoloom.schemas import XML_PAGE

#: Signs that XML has no way to write, each as this sign and a letter while the parser sees them; so is the sign itself.
_MARK = "\ue000"
_CODES = {_MARK: _MARK + "@"} | {chr(k): _MARK + chr(0x100 + k) for k in range(32) if chr(k) not in "\t\n\r"}
_EMPTY = _MARK + "_"


def escaped(text: Column) -> Column:
    """The text as an element's content; a carriage return by its number, as parsers make a bare one a line feed."""
    for sign, name in {"&": "&amp;", "<": "&lt;", ">": "&gt;", "\r": "&#13;"}.items():
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def element(name: str, content: Column, attributes: str = "") -> Column:
    """The element, or nothing for a null content."""
    return F.coalesce(F.concat(F.lit(f"<{name}{attributes}>"), content, F.lit(f"</{name}>")), F.lit(""))


def _guarded(xml: Column) -> Column:
    """xml with its control characters coded, and a mark at the head of titles and texts, so that none is empty or blank."""
    coded = xml
    for sign, code in _CODES.items():
        coded = F.replace(coded, F.lit(sign), F.lit(code))
    safe = F.when(xml.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\ue000]"), coded).otherwise(xml)
    opened = F.regexp_replace(safe, r"<(title|text)(\s[^<>]*)?(?<!/)>", f"<$1$2>{_EMPTY}")
    return F.regexp_replace(opened, r"<(title|text)(\s[^<>]*)?/>", f"<$1$2>{_EMPTY}</$1>")


def _bare(text: Column) -> Column:
    plain = F.replace(text, F.lit(_EMPTY), F.lit(""))
    whole = plain
    for sign, code in reversed(_CODES.items()):
        whole = F.replace(whole, F.lit(code), F.lit(sign))
    return F.when(F.contains(plain, F.lit(_MARK)), whole).otherwise(plain)


def parse_pages(xml: DataFrame) -> DataFrame:
    """(id, title, ns, text): text is the first revision's, null for a page without one.

    Empty and blank texts and titles stay as they are, and control characters, which XML doesn't allow, are taken as they come.
    """
    page = xml.select(F.from_xml(_guarded(F.col("xml")), XML_PAGE, {"ignoreSurroundingSpaces": "false"}).alias("page"))
    text = F.get("page.revision", F.lit(0))["text"]["_VALUE"]
    return page.select("page.id", _bare(F.col("page.title")).alias("title"), "page.ns", _bare(text).alias("text"))


def read_pages(spark: SparkSession, path: str, index: str | None = None, compression: str = "auto", split_bytes: int = 64 << 20) -> DataFrame:
    reader = spark.read.format("xmlrecords").option("rowTag", "page").option("compression", compression).option("splitBytes", str(split_bytes))
    return parse_pages((reader.option("index", index) if index else reader).load(path))
