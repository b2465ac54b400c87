"""Text functions as Column expressions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and the letters that the lexical tokens have in their place.
MARKED = "àáâãäåāăąçćĉċčďđèéêëēĕėęěĝğġģĥìíîïĩīĭįıĵķĺļľłñńņňòóôõöøōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccddeeeeeeeeegggghiiiiiiiiijkllllnnnnooooooooorrrssssttuuuuuuuuuuwyyyzzz"

#: Line ends as Python's splitlines has them.
LINE_END = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x85\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]+"
TERM = r"[\p{L}\p{N}]+"


def casefold(text: Column) -> Column:
    """Lower case with ß as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def lines(text: Column) -> Column:
    """The lines of a text without their ends; a line end at the end of the text begins no line."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores of the folded text."""
    return F.regexp_extract_all(casefold(text), F.lit(WORD), F.lit(0))


def terms(text: Column) -> Column:
    """Lexical index terms: runs of letters and digits, lower case, without marks on letters."""
    return F.regexp_extract_all(F.translate(F.lower(text), MARKED, PLAIN), F.lit(TERM), F.lit(0))


def collapse(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def join_divided(text: Column) -> Column:
    """text with words joined that a hyphen divides at a line end."""
    return F.regexp_replace(text, r"(?U)(?<=\w)-\s*\n\s*(?=\w)", "")


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line, else null."""
    return F.when(line.rlike(r"^#{1,6}\s+\S"), F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1)))


def heading_title(line: Column) -> Column:
    """The title of a heading line, without number signs and blanks after it."""
    return F.trim(F.rtrim(F.trim(F.regexp_extract(line, r"^#{1,6}\s+(.+?)\s*$", 1)), F.lit("#")))


def is_page_marker(line: Column) -> Column:
    return line.rlike(r"(?i)^\s*<!--\s*page\s*:\s*[^>]+?\s*-->\s*$")


def is_blank(line: Column) -> Column:
    return line.rlike(r"(?U)^\s*$")


def glob_pattern(glob: str) -> str:
    """A regular expression for a file name pattern in which * also crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c, i = glob[i], i + 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            inner = glob[i:end].replace("\\", r"\\")
            out += "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]"
            i = end + 1
        else:
            out += "\\" + c if not c.isalnum() and c != "_" else c
    return f"(?s)^{out}$"


def first_bytes(text: Column, limit: int) -> Column:
    """The longest beginning of text of at most limit bytes of UTF-8 that cuts no character."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, limit)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.rtrim(F.make_valid_utf8(cut.cast("string")), F.lit("\ufffd")))


def loose_phrase(phrase: Column) -> Column:
    """A pattern that finds a phrase whatever white space stands between its characters, between
    letters and digits only where none go on; the empty phrase is found everywhere."""
    text = collapse(phrase)
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    escaped = F.transform(characters, lambda c: F.when(c == " ", F.lit(r"\s+")).otherwise(F.concat(F.regexp_replace(c, r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(r"\s*"))))
    body = F.regexp_replace(F.array_join(escaped, ""), r"\\s\*(\\s\+|$)", "$1")
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("(?i)(?<![A-Za-z0-9])(?:"), body, F.lit(")(?![A-Za-z0-9])")))


def stem(term: Column) -> Column:
    """A term without its ending: ies to y, without al, y to i, without s, each only from longer terms."""
    a = F.when(term.endswith("ies") & (F.length(term) > 4), F.regexp_replace(term, "ies$", "y")).otherwise(term)
    b = F.when(a.endswith("al") & (F.length(a) > 5), F.regexp_replace(a, "al$", "")).otherwise(a)
    c = F.when(b.endswith("y") & (F.length(b) > 3), F.regexp_replace(b, "y$", "i")).otherwise(b)
    return F.when(c.endswith("s") & (F.length(c) > 4), F.regexp_replace(c, "s$", "")).otherwise(c)


# What counts as a secret, and how it is shown.
SECRETS = [
    (r"(?i)(api[_-]?key|token|password|secret|authorization)(\s*[:=]\s*)([^\s,;]+)", "$1$2[REDACTED]"),
    (r"(?i)\bBearer\s+[^\s,;]+", "[REDACTED]"),
    (r"\b(?:sk-ant|lin_api)_[A-Za-z0-9_-]{6,}\b", "[REDACTED]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED]"),
]


def redact(text: Column) -> Column:
    """text without secrets."""
    for pattern, shown in SECRETS:
        text = F.regexp_replace(text, pattern, shown)
    return text


# What looks like a credential, and names that mark a path as sensitive.
CREDENTIALS = [r"\bsk-ant-[A-Za-z0-9_-]{12,}\b", r"\blin_api_[A-Za-z0-9_-]{6,}\b", r"\bAKIA[0-9A-Z]{16}\b", r"(?i)\b(?:api[_ -]?key|authorization|password|secret|token)\s*[:=]\s*\S+"]
SENSITIVE = [".aws", ".azure", ".codex-credentials", ".git", ".gnupg", ".ssh", "credentials", "id_rsa", "id_ed25519", "secrets"]
SENSITIVE_ENDINGS = [".key", ".pem", ".p12", ".pfx"]


def holds_credential(text: Column) -> Column:
    out = F.lit(False)
    for pattern in CREDENTIALS:
        out = out | text.rlike(pattern)
    return out


def relative_path(path: Column) -> Column:
    """The parts of a relative path, either slash between them, without empty ones and dots; null for
    one that is blank, absolute, on a drive, or leads up."""
    whole = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))
    bad = (F.trim(path) == "") | whole.startswith("/") | whole.rlike(r"^[A-Za-z]:") | F.array_contains(parts, "..") | F.contains(path, F.lit("\u0000"))
    return F.when(~bad, parts)


def is_sensitive(parts: Column) -> Column:
    """Whether a part of a path names credentials or what holds them."""

    def sensitive(part: Column) -> Column:
        low = casefold(part)
        return low.isin(SENSITIVE) | low.startswith(".env") | F.regexp_extract(low, r"^.+(\.[^.]*)$", 1).isin(SENSITIVE_ENDINGS)

    return F.exists(parts, sensitive)
