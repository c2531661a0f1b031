"""Text and byte expressions: binary test, truncation, counting, tokenising."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Extensions that are always text.
TEXT_EXTENSIONS = [
    ".txt", ".md", ".json", ".xml", ".html", ".css", ".js", ".py", ".go", ".c", ".cpp", ".h",
    ".java", ".sh", ".bat", ".ps1", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".config",
    ".properties", ".env", ".example", ".log", ".gitignore", ".csv", ".tsv",
]

# Markers that make the head of a file count as known text.
TEXT_MARKERS = [
    "<!DOCTYPE", "<html", "<?xml", "{", "[", "//", "/*", "#!", "import ", "package ", "using ",
    "function ", "class ", "def ", "var ", "const ", "let ", "from ", "# ", "// ", "/* ", "; ", "' ",
]

# Limits in bytes.
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_SNIPPET_BYTES = 10000
BINARY_PROBE_BYTES = 1000
MARKER_PROBE_BYTES = 100
SHORT_FILE_BYTES = 32
TRUNCATION_MARK = "... [content truncated]"

UNIT_SEPARATOR = "\x1f"


def _latin1_head(content: Column, n: int) -> Column:
    """First n bytes as a string with one character per byte."""
    return F.decode(F.substring(content, 1, n), "ISO-8859-1")


def is_known_text(content: Column) -> Column:
    """Any marker, ignoring case, anywhere in the first 100 bytes."""
    head = F.lower(_latin1_head(content, MARKER_PROBE_BYTES))
    found = F.lit(False)
    for marker in TEXT_MARKERS:
        found = found | F.contains(head, F.lit(marker.lower()))
    return found


def binary_profile(content: Column) -> Column:
    """Counts the binary test looks at, over the first 1000 bytes."""
    head = _latin1_head(content, BINARY_PROBE_BYTES)
    count = lambda rx: F.regexp_count(head, F.lit(rx)).cast("long")
    return F.struct(
        F.length(head).cast("long").alias("n"),
        count(r"\x00").alias("nul"),
        count(r"[\x01-\x08\x0E-\x1A\x1C-\x1F]").alias("ctrl"),
        count(r"[\x80-\x9F]").alias("ext"),
        (F.hex(F.substring(content, 1, 3)) == "EFBBBF").alias("bom"),
        is_known_text(content).alias("known_text"),
    )


def is_binary(profile: Column) -> Column:
    """The binary rule over a ``binary_profile`` struct; all divisions are integer."""
    n, nul, ctrl, ext = (profile[c] for c in ("n", "nul", "ctrl", "ext"))
    over = lambda count, divisor: count > F.floor(n / F.lit(divisor))
    return (
        F.when(profile["bom"] | (n < SHORT_FILE_BYTES), F.lit(False))
        .when(profile["known_text"], over(nul, 50))
        .otherwise(over(nul, 1000) | over(ctrl, 100) | over(ext, 50))
    )


def decode_text(content: Column) -> Column:
    """Bytes as text; broken sequences become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def truncated_text(content: Column, max_bytes: int = MAX_SNIPPET_BYTES) -> Column:
    """Bytes as text, cut to the first ``max_bytes`` plus a mark if longer."""
    cut = F.concat(decode_text(F.substring(content, 1, max_bytes)), F.lit(TRUNCATION_MARK))
    return F.when(F.octet_length(content) > max_bytes, cut).otherwise(decode_text(content))


def snippet_id(path: Column, start_line: Column, content: Column, at: Column | None = None) -> Column:
    """Content-derived id, so indexing the same file twice writes the same rows.

    ``at``: the byte where a continued file goes on, 0 elsewhere; long lines may repeat themselves.
    """
    later = F.lit(None).cast("string") if at is None else F.when(at > 0, at.cast("string"))
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, path, start_line.cast("string"), content, later), 256)


def embedding_text(path: Column, symbols: Column, content: Column) -> Column:
    with_symbols = F.concat(
        F.lit("File: "), path, F.lit("\nSymbols: "), F.array_join(symbols, ", "), F.lit("\n"), content)
    return F.when(F.size(symbols) > 0, with_symbols).otherwise(
        F.concat(F.lit("File: "), path, F.lit("\n"), content))


def count_occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping literal occurrences, counted on bytes; null for an empty needle."""
    removed = F.octet_length(text) - F.octet_length(F.replace(text, needle, F.lit("")))
    return F.floor(F.try_divide(removed, F.octet_length(needle))).cast("long")


def query_terms(query: Column) -> Column:
    """Lowered, split on Unicode whitespace, duplicates kept."""
    return F.filter(F.split(F.lower(query), r"(?U)\s+"), lambda t: t != "")
