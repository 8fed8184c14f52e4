"""File-type tags from leading bytes: ordered magic table, patterns, tail magic, text detection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = 1024  # magic and container patterns stand at fixed places near the start
TAIL = 512  # the disk-image trailer stands at a fixed place before the end

# Fixed values: (offset, bytes as hex, type, category); the first matching row wins.
MAGIC = [
    (0, "7F454C46", "ELF", "executable"), (0, "CEFAEDFE", "MACHO", "executable"), (0, "CFFAEDFE", "MACHO", "executable"),
    (0, "FEEDFACE", "MACHO", "executable"), (0, "FEEDFACF", "MACHO", "executable"), (0, "CAFEBABE000000", "MACHO_UNIBIN", "executable"),
    (0, "4C00000001140200", "LNK", "executable"), (0, "A3484BBE", "AUTOIT", "executable"), (0, "EFBEADDE", "NULSFT", "executable"),
    (0, "02099900", "PYTHON_COMPILED", "executable"), (0, "0B0D0A", "PYTHON_COMPILED", "executable"),
    (0, "504B0304", "ZIP", "archive"), (0, "504B0506", "ZIP", "archive"), (0, "504B0708", "ZIP", "archive"),
    (0, "526172211A0700", "RAR", "archive"), (0, "526172211A070100", "RAR", "archive"), (0, "377ABCAF271C", "7Z", "archive"),
    (0, "1F8B", "GZ", "archive"), (0, "425A68", "BZ", "archive"), (0, "FD377A585A00", "XZ", "archive"), (0, "28B52FFD", "ZSTD", "archive"),
    (0, "60EA", "ARJ", "archive"), (0, "4D53434600000000", "MSCAB", "archive"), (0, "49545346", "MSCHM", "archive"), (0, "78617221", "XAR", "archive"),
    (0, "45474741", "EGG", "archive"), (0, "414C5A01", "ALZ", "archive"), (257, "7573746172", "POSIX_TAR", "archive"),
    (0, "255044462D", "PDF", "document"), (0, "D0CF11E0A1B11AE1", "MSOLE2", "document"), (0, "7B5C727466", "RTF", "document"),
    (0, "E4525C7B", "ONENOTE", "document"), (0, "48575020446F63756D656E742046696C652056332E303020", "HWP3", "document"),
    (0, "252150532D41646F62652D", "PS", "document"), (0, "789F3E22", "TNEF", "document"), (4, "D0CF11E0A1B11AE1", "HWPOLE2", "document"),
    (0, "89504E47", "PNG", "graphics"), (0, "47494638", "GIF", "graphics"), (0, "FFD8FF", "JPEG", "graphics"), (0, "0000000C6A502020", "GRAPHICS", "graphics"),
    (0, "424D", "GRAPHICS", "graphics"), (0, "49492A00", "TIFF", "graphics"), (0, "4D4D002A", "TIFF", "graphics"),
    (0, "52494646", "RIFF", "media"), (0, "52494658", "RIFF", "media"), (0, "494433", "IGNORED", "media"), (0, "4F676753", "IGNORED", "media"),
    (0, "FFFB", "IGNORED", "media"), (0, "000001B3", "BINARY_DATA", "media"), (0, "000001BA", "BINARY_DATA", "media"),
    (0, "465753", "SWF", "executable"), (0, "435753", "SWF", "executable"), (0, "5A5753", "SWF", "executable"),
    (0, "CAFEBABE00000002", "JAVA", "executable"), (0, "CAFEBABE00000003", "JAVA", "executable"),
    (0, "46726F6D20", "MAIL", "mail"), (0, "46726F6D3A20", "MAIL", "mail"), (0, "52656365697665643A20", "MAIL", "mail"),
    (0, "52657475726E2D506174683A20", "MAIL", "mail"), (0, "44656C6976657265642D546F3A20", "MAIL", "mail"), (0, "4D6573736167652D49443A20", "MAIL", "mail"),
    (0, "5375626A6563743A20", "MAIL", "mail"), (0, "582D4F726967696E6174696E672D49503A20", "MAIL", "mail"),
    (0, "5B616C69617365735D", "SCRIPT", "script"), (0, "626567696E20", "UUENCODED", "text"), (510, "55AA", "MBR", "disk"), (512, "4546492050415254", "GPT", "disk"),
    (0, "53514C69746520666F726D6174203300", "IGNORED", "data"), (0, "23407E5E", "SCRENC", "data"), (0, "535A4444", "MSSZDD", "archive"),
    (0, "47475546", "AI_MODEL", "ai-model"), (4, "54464C33", "AI_MODEL", "ai-model"),
]
# Fixed values: (regular expression over the head as Latin-1 text, type, category), tried in order after the magic table.
PATTERNS = [
    (r"(?s)MZ.{96,772}?PE\x00\x00", "MSEXE", "executable"), (r"(?s)^MZ.{0,996}?PK\x03\x04", "ZIPSFX", "executable"),
    (r"(?s)^MZ.{0,996}?Rar!\x1a\x07\x00", "RARSFX", "executable"), (r"(?s)^MZ.{0,996}?7z\xbc\xaf\x27\x1c", "7ZSFX", "executable"),
    (r"(?s)^MZ.{0,996}?MSCF", "CABSFX", "executable"),
    (r"(?i)<(html|head|script|iframe|img|object|table|a\s[^>]*href|!DOCTYPE|body)\b", "HTML", "document"),
]
# Beginnings of entry names in ZIP containers (any case) with type and category; any entry of an earlier row wins.
ZIP_ENTRIES = [
    ("xl/", "OOXML_XL", "document"), ("ppt/", "OOXML_PPT", "document"), ("word/", "OOXML_WORD", "document"), ("contents/content.hpf", "OOXML_HWP", "document"),
    ("meta-inf/manifest.mf", "JAVA", "executable"), ("mimetypeapplication/vnd.oasis", "ODF", "document"), ("mimetype", "ZIP", "archive"),
    ("[content_types].xml", "ZIP", "document"), ("[contenttypes].xml", "ZIP", "document"), ("docprops/", "ZIP", "document"), ("bindata", "ZIP", "document"),
]


def _tag(kind: str, category: str, method: str) -> Column:
    return F.struct(F.lit(kind).alias("type_code"), F.lit(category).alias("category"), F.lit(method).alias("method"))


def _first_magic(h: Column) -> Column:
    """Position of the first matching magic row: one lookup per distinct (offset, length) instead of one test per row."""
    groups: dict[tuple[int, int], dict[str, int]] = {}
    for i, (off, magic, _, _) in enumerate(MAGIC):
        groups.setdefault((off, len(magic)), {}).setdefault(magic, i)
    found = [F.try_element_at(F.create_map(*[F.lit(x) for kv in g.items() for x in kv]), F.substring(h, 2 * off + 1, n)) for (off, n), g in groups.items()]
    return F.least(*found)


def tag_file_type(df: DataFrame, content: str) -> DataFrame:
    """Add type_code, category and method; no join, no shuffle.

    Magic bytes are looked for at their fixed places.  Markup, text encodings and the shares of printable and zero bytes are
    judged on the whole content.
    """
    size = F.octet_length(content)
    base = df.withColumn("__head", F.substring(content, 1, HEAD)).withColumn("__h", F.hex("__head")).withColumn("__t", F.decode("__head", "ISO-8859-1")).withColumn("__all", F.decode(F.col(content), "ISO-8859-1")) \
        .withColumn("__tail", F.decode(F.substring(F.col(content), F.greatest(size - TAIL + 1, F.lit(1)), F.lit(TAIL)), "ISO-8859-1"))
    h, t, whole = F.col("__h"), F.col("__t"), F.col("__all")
    tag = F.when(size.isNull() | (size == 0), _tag("ANY", "other", "empty"))
    # a local file header has 30 bytes before the entry's name
    for name, kind, category in ZIP_ENTRIES:
        tag = tag.when(h.startswith("504B0304") & whole.rlike(r"(?si)PK\x03\x04.{26}" + re.escape(name)), _tag(kind, category, "entry-name"))
    row = _first_magic(h)
    pick = lambda i: F.element_at(F.array(*[F.lit(m[i]) for m in MAGIC]), row + 1)
    tag = tag.when(row.isNotNull(), F.struct(pick(2).alias("type_code"), pick(3).alias("category"), F.lit("magic").alias("method")))
    for pattern, kind, category in PATTERNS:
        tag = tag.when((whole if kind == "HTML" else t).rlike(pattern), _tag(kind, category, "pattern"))
    tag = tag.when(F.col("__tail").contains("koly"), _tag("DMG", "disk", "tail-magic"))
    n = F.length(whole)
    zeros = n - F.length(F.replace(whole, F.lit("\x00"), F.lit("")))
    printable = F.length(F.regexp_replace(whole, r"[^\x20-\x7e\x09\x0a\x0d]", ""))
    utf8 = F.is_valid_utf8(F.col(content).cast("string"))
    ascii_start = F.substring(t, 1, 1).rlike(r"^[\x00-\x7f]") | F.substring(t, 1, 4).rlike(r"^[\x00-\x7f\xc2-\xff]*$")
    tag = (tag.when(h.startswith("EFBBBF"), _tag("TEXT_UTF8", "text", "text-detect")).when(h.startswith("FFFE"), _tag("TEXT_UTF16LE", "text", "text-detect"))
           .when(h.startswith("FEFF"), _tag("TEXT_UTF16BE", "text", "text-detect"))
           .when((n >= 8) & (zeros > n * 0.35) & ~whole.contains("\r\n\x00"), _tag("TEXT_UTF16LE", "text", "text-detect"))
           .when(utf8 & ascii_start & (printable > n * 0.90), _tag("TEXT_ASCII", "text", "text-detect")).when(utf8, _tag("TEXT_UTF8", "text", "text-detect"))
           .otherwise(_tag("BINARY_DATA", "binary", "fallback")))
    return base.withColumn("__tag", tag).select(*df.columns, "__tag.*")
