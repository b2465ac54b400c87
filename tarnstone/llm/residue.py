"""Template residue, filler and error-page text: few trusted segments, their labels spread over
near-duplicates, found by SimHash tables and shingles, and over the blocks of text they stand in."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnstone.runtime import broadcast_if_small, join_few, materialize

#: Words of a shingle and least similarity of the texts of two near-duplicate segments.
SHINGLE, SIMILARITY = 5, 0.8
#: Most different bits of two SimHashes; with one block more, two such hashes agree in a block. Most
#: similar segments of sentence length differ in more: what the SimHashes lose, SimHasher.keys finds.
RADIUS, BLOCKS = 3, 4
#: The word that stands for an unfilled place in a normal text.
PLACE = "⟦⟧"

# The notations of an unfilled place, each with a string without which it can't stand in a text.
_NAME = r"!?\s?[^\W\d_][\w .’'-]{0,40}?\s?"
_NOTATIONS = [
    ("{{", r"\{\{\{?\s?[^{}|\n,;=>]{1,50}\s?\}?\}\}"), ("{%", r"\{%\s?[^{}%\n]{1,50}\s?%\}"), ("${", rf"\$\{{{_NAME}\}}"), ("{", rf"\{{{_NAME}\}}|\{{\d+(?::[^{{}}\s]{{0,8}})?\}}"), ("$$", rf"\$\${_NAME}\$\$"),
    ("%(", r"%\(\w+\)[sdifr]"), ("%%", rf"%%{_NAME}%%"), ("%s", r"(?<!\w)%s(?!\w)"),
    ("<%", r"<%=?[^<>\n]{1,60}%>"), ("<<", rf"<<{_NAME}>>"), ("<", r"<[^\W\d_][^<>\n|;=(){}/]{0,60}>|<null>"), ("</", r"</(?:error|code|message|noscript|ERROR|CODE|MESSAGE|NOSCRIPT)>"), ("&lt;", rf"&lt;{_NAME}&gt;"), ("«", r"«[^\W\d_](?:[\w .]{0,40}[\w.])?»"),
    ("[[", r"\[\[[^\[\]\n|]{1,50}\]\]"), ("[", r"(?<!\w)\[(?!sic\b|[Ss]ee |[Ss]iehe |[Vv]oir |[Vv]éase |Annex|Anhang|Anexo|Table|\.\.\.|…)(?:●|•|_+|[^\W\d_][^\[\]\n|;=<>]{0,60})\](?![\[(])"), ("【", r"【[^【】\n]{1,30}】"),
    ("@@", r"@@[^@\n]{1,40}@@"), ("#", r"#(?:REF|N/A|NAME|VALUE|DIV/0|NULL|NUM)\b[!?]?|(?<![#\w])#[^\W\d_](?:[\w .]{0,40}[\w.])?#(?![#\w])"), ("__", r"(?<![\w`])__[^\W\d_](?:[\w .]{0,40}?[^\W_])__(?![\w_])"),
    ("***", r"\*\*\*\s?[A-Z][A-Z ]{2,30}\s?\*\*\*"), ("____", r"_{4,}"), ("........", r"\.{8,}"), ("………", r"…{3,}"),
    ("(", r"\((?:to be (?:completed|confirmed|added|supplied|filled in)|to follow|tbc|tbd|bitte ergänzen|noch auszufüllen|folgt|à compléter|à renseigner|à définir|por completar|por definir|pendiente)\)"), ("（", r"（(?:待补充|待填写|待定|请填写|待确认)）"),
    ("XX", r"(?<!\w)X{2,4}[./-]X{2,4}(?:[./-]\w{2,4})?"), ("xx", r"(?<!\w)xx[/.-]xx[/.-]\w{2,4}"), ("??", r"\?\?[/.-]\?\?[/.-]\?{2,4}"), ("00", r"(?<!\d)(?:0000-00-00|00[./]00[./]0000)(?!\d)"),
    ("TT", r"\bTT[./-]MM[./-]JJJJ\b"), ("dd", r"\bdd[./-]mm[./-]yyyy\b"), ("DD", r"\bDD[./-]MM[./-]YYYY\b"), ("JJ", r"\bJJ[./-]MM[./-]AAAA\b"),
    ("TBD", r"(?<!Unit )\bTBD\b(?! \()"), ("TBC", r"\bTBC\b(?! \()"), ("TODO", r"\bTODO\b"), ("NaN", r"\bNaN\b"),
]
_NOTATIONS = [(needle, re.compile(pattern)) for needle, pattern in _NOTATIONS]
# What a program writes for a value that it lacks, where a value is due.
_NO_VALUE = re.compile(
    r"(?:(?::|：|\bDear|\bEUR|\bvon|\bde|\bof|\bin|\bfor|\bat|\bby|\bto|\bthe|\b[Ff]or|\bpour|\bpara|\bfür|致|^|\| ?)\s*)(?:undefined|null|None|nil)(?=\s*(?:$|[,.;:|：，。]|million|Millionen|M EUR|percent|Prozent|%|\s[a-zà-ÿ]))",
    re.M,
)

# The words of the well-known filler, and those of which one must be there.
_LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split())
_LATIN_SIGN = frozenset(["lorem", "ipsum", "dolor", "amet"])

# What designers call filler, in normal form; one sign for each language.
_FILLER = re.compile(r"body copy|dummy content|blindtext|faux texte|contenido de muestra|占位文本")

# Reason phrases of HTTP, also translated, that stand alone but for their number.
_STATUS = re.compile(
    r"(?:(?:http |error |fehler |erreur )?0 |(?:error|fehler|erreur) )?(?:bad request|unauthorized|forbidden|not found|request timeout|too many requests|internal server error|bad gateway|service unavailable|gateway time ?out"
    r"|seite nicht gefunden|page introuvable|página no encontrada|页面未找到)"
)
# What messages of programs and notices about scripts are about, in normal form; prose on such things is longer.
_SUBJECTS = re.compile(
    r"\b(?:javascript|cookies|scripts|skripte|active content)\b|脚本|\b(?:your|votre|su|ihr) (?:browser|navigateur|navegador)\b|您的浏览器"
    r"|\b(?:access denied|accès refusé|zugriff verweigert|acceso denegado)\b|拒绝访问|session has expired|session a expiré|sesión ha caducado|sitzung ist abgelaufen|会话已过期"
    r"|no longer available|n est plus disponible|ya no está disponible|nicht mehr verfügbar|不存在或已被删除|not found on this server"
    r"|temporarily unavailable|\b(?:indisponible|mantenimiento|wartungsarbeiten)\b|系统维护|^oops$|something went wrong|\b(?:erreur interne|error interno|serverfehler)\b|服务器内部错误"
    r"|\w+exception$|database connection|unexpected end of"
)
# How messages begin that may go on at any length.
_BEGINNINGS = re.compile(
    r"(?:traceback most recent call last|warning undefined|status 0 error)\b"
    r"|(?:please |you need to |bitte |veuillez |por favor )?(?:enable|activate|turn on|allow|aktivieren sie|activer|active) (?:javascript|cookies|scripts)\b"
)
# The words of which one stands in every message and filler above, and the first words
# of beginnings: segments without any need no search. Chinese, without blanks between words, does.
_MARKS = frozenset(
    "javascript cookies scripts skripte content browser navigateur navegador denied refusé verweigert denegado expired expiré caducado abgelaufen available disponible verfügbar "
    "server unavailable indisponible mantenimiento wartungsarbeiten oops wrong erreur error serverfehler database unexpected request unauthorized forbidden found timeout requests gateway out gefunden introuvable encontrada "
    "copy dummy blindtext faux muestra".split()
)
_FIRST = frozenset("traceback warning status please you bitte veuillez por enable activate turn allow aktivieren activer active".split())
_HAN = re.compile(r"[\u4e00-\u9fff]")
#: Most words of a message that is trusted, and of filler.
TRUSTED_WORDS = 12
#: Share of the documents with a segment in which it must stand in a block with residue to be residue
#: too, and the least number of such documents.
SHARE, SUPPORT = 0.5, 2

_FENCE = re.compile(r"^```.*?^```[^\n]*$|`[^`\n]*`", re.M | re.S)
_QUOTED = re.compile(r"“[^“”\n]*”|„[^„“\n]*“|«[\s ][^»\n]*[\s ]»|\"(?<![\w=:{,]\")(?<![:,] \")[^\"\n]{2,80}\"(?![:,}])|‘[^‘’\n]{2,80}’")
_CUT = re.compile(r"[.!?][^\S\f]+|[。！？]")
_BLANK_LINES = re.compile(r"\n[^\S\n]*\n\s*|\f")
_DIGITS = re.compile(r"[0-9]+")
_DROP = re.compile(rf"[^\w\n\f{PLACE}]+")


def _keyboard(words: list[str]) -> bool:
    """Whether the words are struck on few keys: only letters of the home row and its neighbours, and rare ones often."""
    letters = "".join(words)
    return len(words) >= 3 and len(letters) >= 10 and not letters.strip("adefjklqrsw") and sum(map(letters.count, "jkqw")) >= 0.12 * len(letters)


def kind_of(normal: str, words: list[str] | None = None) -> str | None:
    """What residue a segment in normal form is, by the trusted signs; None if none. words: the
    segment at its blanks, if it was split already."""
    if PLACE in normal:
        return "place"
    words = words or normal.split(" ")
    if words[0] in _FIRST and _BEGINNINGS.match(normal):
        return "message"
    if len(words) <= TRUSTED_WORDS and not (_MARKS.isdisjoint(words) and (normal.isascii() or not _HAN.search(normal)) and not words[-1].endswith("exception")):
        if _SUBJECTS.search(normal) or _STATUS.fullmatch(normal):
            return "message"
        if _FILLER.search(normal):
            return "filler"
    if len(words) >= 3:
        if not _LATIN_SIGN.isdisjoint(words) and sum(w in _LATIN for w in words) >= 0.25 * len(words):
            return "filler"
        first = words[0]
        if first == words[1] and len(set(words)) == 1 and first.isalpha() and len(first) > 2:
            return "filler"
        if not first.strip("adefjklqrsw") and _keyboard(words):
            return "filler"
    return None


def _place(m: re.Match) -> str:
    text, line = m[0], m.string
    if text[0] in "_.…" and len(set(text)) == 1:  # a blank counts inside a line; alone it is a ruling, before a page number a table of contents
        start, end = line.rfind("\n", 0, m.start()) + 1, line.find("\n", m.end())
        rest = line[m.end() : end if end >= 0 else len(line)].strip()
        before = line[start : m.start()].strip()
        if not (before or rest).strip("_.*- ") or (text[0] != "_" and rest.isdigit()):
            return text
    return f" {PLACE} "


def blocks(text: str) -> list[list[str]]:
    """The blocks of a text, that is what stands between blank lines, each as its sentences and
    lines in normal form, without code and quotations.

    Unfilled places come out as one word of their own, numbers as 0, letters in lower case."""
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    if "`" in text:
        text = _FENCE.sub(" ", text)
    for needle, pattern in _NOTATIONS:
        if needle in text:
            text = pattern.sub(_place, text)
    if "null" in text or "undef" in text or "None" in text or "nil" in text:
        text = _NO_VALUE.sub(f" {PLACE} ", text)
    if "“" in text or '"' in text or "„" in text or "«" in text or "‘" in text:
        text = _QUOTED.sub(" ", text)
    text = _BLANK_LINES.sub("\n\f", text)  # a form feed begins a block
    lines = _CUT.sub("\n", _DIGITS.sub("0", text.lower())).replace("_", " ")
    out: list[list[str]] = [[]]
    for line in _DROP.sub(" ", lines).split("\n"):
        if "\f" in line and out[-1]:
            out.append([])
        if normal := line.replace("\f", " ").strip():
            out[-1].append(normal)
    return out if out[-1] else out[:-1]


def segments(text: str) -> list[str]:
    """The segments of all blocks of a text."""
    return [normal for block in blocks(text) for normal in block]


class SimHasher:
    """64-bit SimHashes and shingle keys of lists of words; the bits and the hash of each word are kept."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.signs = np.empty((4096, 64), np.int8)
        self.words = np.empty(4096, np.uint64)

    def _number(self, word: str) -> int:
        import xxhash

        n = self.index[word] = len(self.index)
        if n == len(self.signs):
            self.signs = np.concatenate([self.signs, np.empty_like(self.signs)])
            self.words = np.concatenate([self.words, np.empty_like(self.words)])
        digest = xxhash.xxh64_digest(word)
        self.signs[n] = np.unpackbits(np.frombuffer(digest, np.uint8)).astype(np.int8) * 2 - 1
        self.words[n] = int.from_bytes(digest)
        return n

    def numbers(self, lists: list[list[str]]) -> np.ndarray:
        """The numbers of the words of all lists; they hold until the next call."""
        if len(self.index) > 300_000:
            self.__init__()
        index = self.index
        return np.array([index[w] if w in index else self._number(w) for words in lists for w in words], np.int64)

    def hashes(self, lists: list[list[str]], numbers: np.ndarray | None = None) -> np.ndarray:
        if not lists:
            return np.zeros(0, np.int64)
        numbers = self.numbers(lists) if numbers is None else numbers
        starts = np.cumsum([0, *map(len, lists[:-1])])
        sums = np.add.reduceat(self.signs[numbers], starts, axis=0, dtype=np.int32)
        return np.packbits(sums > 0, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)

    def keys(self, lists: list[list[str]], numbers: np.ndarray | None = None) -> pa.ListArray:
        """For each list the keys, below 0, of its shingles with the least hashes: of m different ones
        m - ceil(SIMILARITY * m) + 1, so that lists at SIMILARITY or more always share a key.

        Such lists have ceil(SIMILARITY * m) shingles in common for the m of either, so the least
        common one is among these in both."""
        numbers = self.numbers(lists) if numbers is None else numbers
        places = len(numbers) - SHINGLE + 1
        if places <= 0:
            return pa.ListArray.from_arrays(pa.array([0] * (len(lists) + 1), pa.int32()), pa.array([], pa.int32()))
        words = self.words[numbers]
        h = words[:places].copy()
        with np.errstate(over="ignore"):
            for k in range(1, SHINGLE):
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[k : places + k]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(31)
        sizes = np.array([len(x) for x in lists])
        of = np.repeat(np.arange(len(lists)), sizes)[:places]
        inside = np.arange(places) + SHINGLE <= np.cumsum(sizes)[of]
        bits = np.uint64(len(lists).bit_length())  # the number of the list goes above the hash
        ordered = np.unique((of[inside].astype(np.uint64) << (np.uint64(64) - bits)) | (h[inside] >> bits))
        of = (ordered >> (np.uint64(64) - bits)).astype(np.int64)
        m = np.bincount(of, minlength=len(lists))
        kept = np.where(m > 0, m - np.ceil(SIMILARITY * m - 1e-9).astype(np.int64) + 1, 0)
        chosen = ordered[np.arange(len(ordered)) - (np.cumsum(m) - m)[of] < kept[of]]
        values = -1 - ((chosen << bits) >> np.uint64(33)).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), pa.array(values, pa.int32()))


_SEGMENT = "doc_id bigint, block_no int, segment_id bigint, simhash bigint, residue string, normal string, keys array<int>"


def document_segments(documents: DataFrame) -> DataFrame:
    """(doc_id, block_no, segment_id, simhash, residue, normal, keys): the segments of each text,
    each once a block.

    residue is the kind of a trusted residue segment. Of segments under SHINGLE words that are none
    only the ids are kept: no other segment can be similar to them without being equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher = SimHasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                docs, places, ids, kinds, normals, lists = [], [], [], [], [], []
                part = batch.slice(at, 200)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    seen: dict = {}
                    for place, block in enumerate(blocks(text)):
                        for normal in dict.fromkeys(block):
                            docs.append(doc)
                            places.append(place)
                            if normal in seen:  # its words are with its first occurrence
                                digest, kind = seen[normal]
                                words = []
                            else:
                                words = normal.split(" ")
                                digest, kind = seen[normal] = xxhash.xxh64_intdigest(normal) - (1 << 63), kind_of(normal, words)
                                if not kind and len(words) < SHINGLE:
                                    words = []
                            ids.append(digest)
                            kinds.append(kind)
                            normals.append(normal if words else None)
                            lists.append(words)
                at_words = [i for i, words in enumerate(lists) if words]
                full = [lists[i] for i in at_words]
                numbers = hasher.numbers(full)
                place_of = np.full(len(lists), -1)
                place_of[at_words] = np.arange(len(full))
                index = pa.array(place_of, mask=place_of < 0)
                columns = [pa.array(docs, pa.int64()), pa.array(places, pa.int32()), pa.array(ids, pa.int64()), pa.array(hasher.hashes(full, numbers)).take(index), pa.array(kinds, pa.string()), pa.array(normals, pa.string()), hasher.keys(full, numbers).take(index)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "block_no", "segment_id", "simhash", "residue", "normal", "keys"])

    return documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, _SEGMENT)


def with_keys(segments_: DataFrame) -> DataFrame:
    """segments_ (segment_id, simhash, residue, normal) with the shingle keys of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SimHasher()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, hasher.keys([x.split(" ") for x in b.column(3).to_pylist()])], names=[*b.schema.names, "keys"])

    return segments_.select("segment_id", "simhash", "residue", "normal").mapInArrow(run, "segment_id bigint, simhash bigint, residue string, normal string, keys array<int>")


def _blocks(side: DataFrame) -> DataFrame:
    """(segment_id, simhash, block): a row for each block of bits of the SimHash, the tables of the
    search, and for each shingle key, which is below 0. No texts, since long ones have many keys."""
    width = 64 // BLOCKS
    keys = F.array(*((F.lit(i << width) + F.shiftrightunsigned("simhash", 64 - width * (i + 1)).bitwiseAND((1 << width) - 1)).cast("int") for i in range(BLOCKS)))
    return side.select("segment_id", "simhash", F.explode(F.concat(keys, "keys")).alias("block"))


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def grams(text: str) -> set[tuple[str, ...]]:
        w = text.split(" ")
        return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}

    for b in batches:
        keep = []
        for x, y in zip(b.normal, b.normal_from):
            a, c = grams(x), grams(y)
            keep.append(len(a & c) >= SIMILARITY * len(a | c))
        yield b.loc[keep, ["segment_id", "simhash", "residue", "normal", "keys"]]


def near_segments(rest: DataFrame, front: DataFrame, labelled: DataFrame) -> DataFrame:
    """(segment_id, simhash, residue, normal, keys) of the segments of rest that are near-duplicates
    of a segment of front, with its residue, without those that labelled has.

    Near-duplicates have shingles with a similarity of SIMILARITY or more. Their SimHashes differ
    in at most RADIUS bits, or else they share a shingle key: no such link is lost."""
    asked = _blocks(front).select("block", F.col("simhash").alias("simhash_from"), F.col("segment_id").alias("id_from"))
    close = _blocks(rest).join(broadcast_if_small(materialize(asked, "residue-asked")), "block").where((F.col("block") < 0) | (F.bit_count(F.col("simhash").bitwiseXOR(F.col("simhash_from"))) <= RADIUS))
    pairs = materialize(close.select("segment_id", "id_from").distinct().join(broadcast_if_small(labelled.select("segment_id")), "segment_id", "left_anti"), "residue-pairs")
    met = join_few(rest, pairs, ["segment_id"]).dropDuplicates(["segment_id", "id_from"])
    source = front.select(F.col("segment_id").alias("id_from"), "residue", F.col("normal").alias("normal_from"))
    reached = met.join(broadcast_if_small(source), "id_from").mapInPandas(_similar, "segment_id bigint, simhash bigint, residue string, normal string, keys array<int>")
    return reached.groupBy("segment_id").agg(F.min("residue").alias("residue"), *(F.first(c).alias(c) for c in ("simhash", "normal", "keys")))


def block_segments(places: DataFrame, labelled: DataFrame, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """(segment_id, residue) of the segments that stand in blocks with residue and hardly elsewhere:
    in at least support documents, and in at least that share of the documents that have them.

    places: doc_id, block_no, segment_id. A message goes with the sentences around it, filler with
    other filler; prose that a message happens to stand beside is found without it too. Unfilled
    places don't count, since the sentences around them are no residue."""
    sources = labelled.where(F.col("residue") != "place")
    inside = places.join(broadcast_if_small(sources), "segment_id").groupBy("doc_id", "block_no").agg(F.min("residue").alias("residue"))
    inside = materialize(inside, "residue-blocks")
    beside = places.join(broadcast_if_small(inside), ["doc_id", "block_no"]).join(broadcast_if_small(labelled.select("segment_id")), "segment_id", "left_anti")
    beside = beside.groupBy("segment_id").agg(F.countDistinct("doc_id").alias("n_beside"), F.min("residue").alias("residue")).where(F.col("n_beside") >= support)
    beside = materialize(beside, "residue-beside")
    everywhere = places.join(broadcast_if_small(beside.select("segment_id")), "segment_id", "left_semi").groupBy("segment_id").agg(F.countDistinct("doc_id").alias("n_documents"))
    return beside.join(everywhere, "segment_id").where(F.col("n_beside") >= share * F.col("n_documents")).select("segment_id", "residue")


def spread(segments_: DataFrame) -> DataFrame:
    """(segment_id, residue): the trusted segments and all in their connected components.

    Links join near-duplicates (near_segments) and, where segments_ has doc_id and block_no, what
    goes together in blocks (block_segments). Labels go out from the trusted segments, a link
    further in each round, until no segment is new; components without a trusted segment need no
    work. Of an unfilled place the sentence around it is no residue, so from there no label goes
    out. Keys are made here if segments_ has none."""
    columns = ["segment_id", "simhash", "residue", "normal", "keys"]
    in_blocks = {"doc_id", "block_no"} <= set(segments_.columns)
    keyed = segments_ if "keys" in segments_.columns else materialize(with_keys(segments_), "residue-keys")
    worded = keyed.where(F.col("normal").isNotNull()).select(*columns)
    front = materialize(worded.where(F.col("residue").isNotNull()).dropDuplicates(["segment_id"]), "residue-seeds")
    rest = worded.where(F.col("residue").isNull()).drop("residue")
    labelled = front.select("segment_id", "residue")
    front = front.where(F.col("residue") != "place")
    while True:
        front = front.where(F.size(F.split("normal", " ")) >= SHINGLE)
        new = materialize(near_segments(rest, front, labelled), "residue-reached")
        front, added = new.select(*columns), [new.select("segment_id", "residue")]
        if in_blocks:
            beside = materialize(block_segments(segments_.select("doc_id", "block_no", "segment_id"), labelled.unionByName(added[0])), "residue-joined")
            worded_beside = join_few(worded.drop("residue"), beside, ["segment_id"]).select(*columns).dropDuplicates(["segment_id"])
            front = front.unionByName(worded_beside)
            added.append(beside)
        labels = added[0] if len(added) == 1 else added[0].unionByName(added[1])
        if labels.isEmpty():
            return labelled
        front = materialize(front, "residue-front")
        labelled = materialize(labelled.unionByName(labels), "residue-labels")


def residue_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, kinds, n_segments): the documents to exclude, with the kinds of residue in them and
    the number of segments that are residue.

    documents: doc_id bigint, text; other columns don't matter. Null, empty and blank texts are not
    excluded; repeated rows count once; an empty table gives no rows."""
    rows = materialize(document_segments(documents), "segments")
    labels = spread(rows)
    hits = rows.select("doc_id", "segment_id").join(broadcast_if_small(labels), "segment_id")
    return hits.distinct().groupBy("doc_id").agg(F.array_sort(F.collect_set("residue")).alias("kinds"), F.count("*").alias("n_segments"))
