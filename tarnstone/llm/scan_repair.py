"""Repair of text from scanned pages: lines labelled by a hidden Markov model, then put together again."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnstone.runtime import broadcast_if_small, join_few, materialize

#: Labels of lines. Headings, tables, lists and page marker comments are structure.
STATES = ["body", "header", "page_no", "break", "structure"]
BODY, HEADER, PAGE_NO, BREAK, STRUCTURE = range(5)

#: Most characters of a word of any language; a longer run is a code and isn't looked up.
LONGEST = 100
#: Lines of a run of text that may be a page end with its furniture; longer runs are mostly body.
SHORT_RUN = 4
#: Rounds in which the model is fitted anew to the lines of all scanned texts.
ROUNDS = 2
#: Weight of the first model against the counts, in lines.
PRIOR_LINES = 50.0

# What the recognition of characters confuses, as it reads them, and what stood there.
MISREAD = {
    "c": ["e"], "+": ["t"], "ri": ["n"], "1": ["i", "l", "I"], "å": ["a"], "0": ["o", "O"], "5": ["s", "S"],
    "ii": ["u"], "rn": ["m"], "q": ["g"], "h": ["li"], "b": ["h"], "u": ["ti"], "6": ["b"], "w": ["vi"],
    "$": ["S"], "m": ["rn"], "|": ["I", "l"], "8": ["B"], "ﬁ": ["fi"], "ﬂ": ["fl"], "Å": ["A"], "Q": ["G"],
    "RI": ["N"], "RN": ["M"], "C": ["E"], "li": ["h"], "cl": ["d"], "vv": ["w"], "l": ["i", "I"], "I": ["l"],
}
#: Marks that divide a word at the end of a line.
DIVIDERS = "-­‐¬"
#: Words for page, in lower case.
PAGE_WORDS = ["page", "seite", "página", "pagina", "pág", "blatt", "hoja", "p", "s"]

_FOLDS = [("rn", "m"), ("ri", "n"), ("ii", "u"), ("ti", "u"), ("li", "h"), ("vi", "w"), ("ﬁ", "fi"), ("ﬂ", "fl")]
_FOLD = str.maketrans("+å0$51|i68hqc", "taosslllbbbge")
_DIGITS = str.maketrans("lI|iOoåSsB", "1111000558")
_NUMBER = r"[0-9lI|iOoSsB]{1,4}"
_PAGE_LINE = re.compile(rf"^[-–—\[(·•~|\s]*(?P<word>[^\W\d_]{{1,7}}\.?\s+)?(?P<no>{_NUMBER})(?P<of>\s*(?:/|[^\W\d_]{{2,3}})\s*{_NUMBER})?(?P<tail>[\W_]*)$")
_NO_DIGITS = re.compile(r"[0-9]+")
_EDGE_NUMBER = re.compile(rf"^\s*{_NUMBER}\s+(?=\S)|\s+{_NUMBER}\s*$")
_MARKER = re.compile(r"^\s*<!--\s*page\b\D*(\d+)?.*-->\s*$", re.I)
_HEADING = re.compile(r"^#{1,6}\s")
_LIST = re.compile(r"^\s*(?:[-*•+]|\d+[.)])\s+\S")
#: Signs of scanning, any of which makes a text one whose lines are labelled, for the JVM: a line that
#: doesn't end a sentence and goes on in lower case or in a script without case; a page marker; a
#: divided word.
SIGNS = [
    r"\n(?<=[^\s.:;!?|。！？：；]\n)[\p{Ll}\p{Lo}]", r"<!--\s*+[Pp][Aa][Gg][Ee]\b", rf"\n(?<=\p{{L}}[{DIVIDERS}]\n)",
]
#: A line with nothing but what may be a page number; two such lines are a sign too.
_NUMBER_LINE = r"\n[ \t]*+[-–—\[(·•~|]*+[ \t]*+(?:\p{L}{1,7}\.?[ \t]++)?[0-9lI|iOoSsBvxcVXLC]{1,14}(?:[ \t]*(?:/|\p{L}{2,3})[ \t]*[0-9lI|iOoSsB]{1,4})?[ \t.\-–—\])·•~|]*+(?=\n|$)"
_STRIP = ".,;:()[]{}\"'»«“”„‚‘’*_—–!?…#`<>¿¡%"


def fold(text: str) -> str:
    """text with characters that are mistaken for each other made equal, letters only."""
    text = text.lower()
    for a, b in _FOLDS:
        text = text.replace(a, b)
    return re.sub(r"[\W_]+|\d+", "", text.translate(_FOLD))


_PAGE_FOLDED = {fold(w) for w in PAGE_WORDS}


_ROMAN = re.compile(r"^[-–—\[(·•~|\s]*([ivxlc1]{1,14}|[IVXLC1]{1,14})[-–—\])·•~|.\s]*$")
_ROMAN_FORM = re.compile(r"c*(?:xc|xl|l?x*)(?:ix|iv|v?i{0,3})")  # also of old style, forty as xxxx
_ROMAN_VALUES = {"i": 1, "1": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def _roman(text: str) -> int | None:
    """The value of a roman number, smaller digits before larger ones taken off; None for letters
    that are no such number."""
    if not _ROMAN_FORM.fullmatch(text.lower().replace("1", "i")):
        return None
    values = [_ROMAN_VALUES[c] for c in text.lower()]
    return sum(-v if v < max(values[i:]) else v for i, v in enumerate(values))


def page_number(line: str) -> tuple[int, int] | None:
    """(number, kind) of a line that may hold just a page number; kind 1: bare, 2: with a full stop, 3: decorated."""
    text = line.strip()
    if (m := _ROMAN.match(text)) and not m[1].isdigit() and (value := _roman(m[1])):
        return value, 1 if text == m[1] else 3
    if not (m := _PAGE_LINE.match(text)):
        return None
    if m["word"] and fold(m["word"]) not in _PAGE_FOLDED:
        return None
    digits = m["no"].translate(_DIGITS)
    read_as_letters = len(m["no"]) > 1 and set(m["no"]) <= set("lIO|")
    if not digits.isdigit() or not (read_as_letters or any(c.isdigit() for c in text)):
        return None
    decorated = m["word"] or m["of"] or text[0] in "-–—[(·•~|" and not text[0].isalnum()
    if m["tail"].strip(" .-–—])·•~|"):
        return None
    return int(digits), 3 if decorated else 2 if m["tail"].strip() else 1


def _grams(text: str) -> set[str]:
    return {text[i : i + 2] for i in range(len(text) - 1)}


def _similar(a: str, own: set[str], b: str, grams: set[str]) -> bool:
    """Whether a is b with few changes; own and grams are their pairs of letters, of which most must be common."""
    if not 0.6 <= len(a) / len(b) <= 1.67:
        return False
    if a == b:
        return True
    return len(own & grams) >= 0.5 * max(len(own), len(grams)) and SequenceMatcher(None, a, b, False).ratio() >= 0.82


def line_symbols(text: str, path: str | None) -> list[int]:
    """The layout features of each line by itself as one number, the observations of the model.

    0 blank, 1 page marker, 2 heading, 3 table, 4 list; else 8 + kind of page number (4) * 8 +
    fits the sequence of pages * 4 + like the title, the site or another line * 2 + in a run of
    more than SHORT_RUN lines. What stands before and after a line is left to the model."""
    lines = text.split("\n")
    title = next((fold(x.lstrip("#")) for x in lines if _HEADING.match(x)), "")
    parts = (path or "").replace("\\", "/").strip("/").split("/")
    site = fold(re.sub(r"-\d+$", "", parts[1]).replace("-", " ")) if len(parts) > 1 else ""
    n = len(lines)
    plain, number, marked = [False] * n, [None] * n, []
    out = [0] * n
    for i, line in enumerate(lines):
        text_ = line.strip()
        if not text_:
            continue
        if m := _MARKER.match(line):
            out[i] = 1
            marked.append(int(m[1] or 0))
        elif _HEADING.match(line):
            out[i] = 2
        elif text_[0] == "|" and text_.count("|") > 1:
            out[i] = 3
        elif (p := page_number(line)) and not (_LIST.match(line) and p[1] < 2):
            number[i], plain[i] = p, True
        elif _LIST.match(line) and not (text_[0] == "-" and text_[-1] == "-"):
            out[i] = 4
        else:
            plain[i] = True
    found = {p[0] for p in number if p} | {m for m in marked}
    count = Counter(p[0] for p in number if p) + Counter(marked)
    long, i = [False] * n, 0
    while i < n:  # runs of plain lines and page markers
        j = i
        while j < n and (plain[j] or out[j] == 1):
            j += 1
        if j - i > SHORT_RUN:
            long[i:j] = [True] * (j - i)
        i = max(j, i + 1)
    known = set(f"{parts[1] if len(parts) > 1 else ''} {next((x for x in lines if _HEADING.match(x)), '')}".lower().replace("-", " ").split())
    bare = {i: _NO_DIGITS.sub("", lines[i]).strip() for i in range(n) if long[i] and plain[i] and not number[i]}
    again = {x for x, k in Counter(bare.values()).items() if k > 1}
    folded = {}
    for i in range(n):
        if plain[i] and not number[i]:  # a line of body is folded only if it can be like something
            if not long[i] or bare[i] in again or 2 * sum(w in known for w in lines[i].lower().split()) >= len(lines[i].split()) - 1:
                folded[i] = fold(_EDGE_NUMBER.sub("", lines[i]))
    often = {x for x, k in Counter(folded.values()).items() if k > 1 and len(x) > 3}
    like: dict[str, bool] = {}
    targets = [(x, _grams(x)) for x in (title, site, title + site, site + title) if len(x) > 3]
    for i in range(n):
        if plain[i]:
            kind = fits = near = 0
            if number[i]:
                no, kind = number[i]
                fits = bool({no - 1, no + 1} & found) or count[no] > 1
            elif len(x := folded.get(i, "")) > 3:
                if x not in like:
                    own = _grams(x)
                    like[x] = any(_similar(x, own, *t) for t in targets)
                near = like[x] or (x in often and not lines[i].rstrip().endswith((".", "!", "?", ":")))
            out[i] = 8 + kind * 8 + fits * 4 + near * 2 + long[i]
    return out


SYMBOLS = 8 + 4 * 8


def first_model() -> tuple[np.ndarray, np.ndarray]:
    """(transitions, emissions), logarithms, before the lines are seen: what each label looks like;
    of what follows what nothing is known, that is learnt from the lines."""
    emit = np.full((5, SYMBOLS), 1e-4)
    emit[BREAK, 0] = 1
    emit[STRUCTURE, 1:5] = 0.25
    for s in range(8, SYMBOLS):
        kind, fits, near, long = (s - 8) // 8, (s - 8) // 4 % 2, (s - 8) // 2 % 2, (s - 8) % 2
        if kind:
            emit[PAGE_NO, s] = {1: 0.3, 2: 0.1, 3: 1.0}[kind] * (1.0 if fits else 0.1) * (0.5 if long else 1.0)
            emit[BODY, s] = {1: 0.003, 2: 0.02, 3: 0.001}[kind]
        elif near:
            emit[HEADER, s] = 0.002 if long else 1.0
            emit[BODY, s] = 0.03
        else:
            emit[BODY, s] = 1
    return np.log(np.full((5, 5), 0.2)), np.log(emit / emit.sum(1, keepdims=True))


def viterbi(texts: list, move: np.ndarray, emit: np.ndarray) -> list[np.ndarray]:
    """The most likely labels of the lines of each text; texts of like length go side by side."""
    start = np.where(np.isin(np.arange(5), (BODY, STRUCTURE)), 0.0, -3.0)
    paths: list = [None] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    for at in range(0, len(order), 128):
        part = order[at : at + 128]
        sizes = np.array([len(texts[i]) for i in part])
        longest = int(sizes.max())
        symbols = np.zeros((len(part), max(longest, 1)), np.int64)
        for k, i in enumerate(part):
            symbols[k, : sizes[k]] = texts[i]
        score = start + emit[:, symbols[:, 0]].T
        back = np.zeros((longest, len(part), 5), np.int8)
        last = np.zeros((len(part), 5))
        last[sizes == 1] = score[sizes == 1]
        for t in range(1, longest):
            into = score[:, :, None] + move[None]
            best = into.argmax(1)
            back[t] = best
            score = np.take_along_axis(into, best[:, None], 1)[:, 0] + emit[:, symbols[:, t]].T
            ended = sizes == t + 1
            last[ended] = score[ended]
        for k, i in enumerate(part):
            path = np.empty(sizes[k], np.int64)
            state = int(last[k].argmax())
            for t in range(sizes[k] - 1, -1, -1):
                path[t] = state
                state = back[t, k, state]
            paths[i] = path
    return paths


def scanned_lines(revisions: DataFrame) -> DataFrame:
    """(revision_id, markdown, symbols): each text with a sign of scanning once, with the features
    of its lines. A text without any has neither page furniture nor wrapped lines."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"revision_id": b.revision_id, "markdown": b.markdown, "symbols": [line_symbols(t, p) for t, p in zip(b.markdown, b.source_path)]})

    sign = F.lit(False)
    for pattern in SIGNS:
        sign = sign | F.col("markdown").rlike(pattern)
    sign = sign | (F.regexp_count("markdown", F.lit(_NUMBER_LINE)) >= 2)
    once = revisions.where(F.col("revision_id").isNotNull() & sign).select("revision_id", "source_path", "markdown").dropDuplicates(["revision_id"])
    return once.mapInPandas(features, "revision_id string, markdown string, symbols array<int>")


def fit(lines: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The model fitted to the lines of all scanned texts: each round labels them by the model so
    far and counts labels and transitions. The counts, a fixed number of rows, go to the driver."""
    first = move, emit = first_model()
    for _ in range(rounds):

        def counts(batches: Iterator[pd.DataFrame], move=move, emit=emit) -> Iterator[pd.DataFrame]:
            seen: Counter = Counter()
            for b in batches:
                for symbols, path in zip(b.symbols, viterbi(list(b.symbols), move, emit)):
                    seen.update((path * 1000 + symbols).tolist())
                    seen.update((10_000 + path[:-1] * 1000 + path[1:]).tolist())
            yield pd.DataFrame([(k // 10_000, k // 1000 % 10, k % 1000, n) for k, n in seen.items()], columns=["kind", "a", "b", "n"])

        total = lines.select("symbols").mapInPandas(counts, "kind int, a int, b int, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
        move, emit = np.exp(first[0]) * PRIOR_LINES, np.exp(first[1]) * PRIOR_LINES
        for r in total:
            (move if r.kind else emit)[r.a, r.b] += r.n
        move, emit = np.log(move / move.sum(1, keepdims=True)), np.log(emit / emit.sum(1, keepdims=True))
    return move, emit


def words(text: str) -> Iterator[str]:
    """The words between white space, without punctuation around them."""
    for w in text.split():
        w = w.strip(_STRIP)
        if w:
            yield w


_LETTERED = re.compile(r"[^\W\d_]")
_ODD = re.compile(r"[0-9+$|åÅﬁﬂ]")
_WORDLIKE = re.compile(r"^[^\W_+$|ﬁﬂ]*(?:[+$|ﬁﬂ]?[^\W_]+)*[+$|ﬁﬂ]?$")


def _countable(w: str) -> bool:
    return len(w) <= LONGEST and bool(_LETTERED.search(w))


def word_counts(revisions: DataFrame) -> DataFrame:
    """(word, n): how often each word stands in all markdown, words with an inner hyphen as one."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for t in b.markdown:
                seen.update(t.split())
            clean: Counter = Counter()
            for w, n in seen.items():
                w = w.strip(_STRIP)
                if w and _countable(w):
                    clean[w] += n
            yield pd.DataFrame({"word": list(clean), "n": list(clean.values())})

    return revisions.where(F.col("markdown").isNotNull()).select("markdown").mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def corrections(word: str) -> list[str]:
    """The words that could have been read as word, with one confusion undone, or two of which one
    left a digit or sign; a word with more than four of those isn't made right by two."""
    once = {word[:i] + right + word[i + len(read) :] for read, rights in MISREAD.items() for i in range(len(word)) if word.startswith(read, i) for right in rights}
    odd = {w for w in once if _ODD.search(w)} if 0 < len(_ODD.findall(word)) <= 4 else set()
    twice = {w[:i] + right + w[i + len(read) :] for w in odd for read, rights in MISREAD.items() if _ODD.search(read) for i in range(len(w)) if w.startswith(read, i) for right in rights}
    return sorted((once | twice) - {word})


_TOKENS = "revision_id string, kind string, line_no int, next_line int, split_at int, word string, other string, words array<string>"


def _tokens(move: np.ndarray, emit: np.ndarray):
    """Labels the lines and lists what has to be looked up: divided words and the words of body lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rid, text, symbols, path in zip(b.revision_id, b.markdown, b.symbols, viterbi(list(b.symbols), move, emit)):
                lines, path = text.split("\n"), path.tolist()
                body = [i for i, s in enumerate(path) if s == BODY or symbols[i] == 4]
                follow = {}
                for i, j in zip(body, body[1:]):
                    if all(path[k] in (BREAK, HEADER, PAGE_NO) or symbols[k] == 1 for k in range(i + 1, j)):
                        follow[i] = j
                skip: dict[int, int] = {}
                for i, s in enumerate(path):
                    if s in (HEADER, PAGE_NO):
                        rows.append((rid, STATES[s], i + 1, 0, 0, "", "", None))
                        continue
                    if symbols[i] in (0, 1):
                        continue
                    parts = lines[i].split()
                    start = skip.get(i, 0)
                    end = len(parts)
                    if i in follow and len(parts[-1]) > 1 and parts[-1][-1] in DIVIDERS and parts[-1][-2].isalpha():
                        after = lines[follow[i]].split()
                        if after and after[0][0].isalpha():
                            left, right = parts[-1][:-1].lstrip(_STRIP), after[0].rstrip(_STRIP)
                            rows.append((rid, "hyphen", i + 1, follow[i] + 1, len(left), left + right, "" if parts[-1][-1] != "-" else left + "-" + right, None))
                            end, skip[follow[i]] = end - 1, 1
                    own = {w for x in parts[start:end] if (w := x.strip(_STRIP)) and _countable(w)}
                    if own:
                        rows.append((rid, "words", i + 1, 0, 0, "", "", sorted(own)))
            yield pd.DataFrame(rows, columns=["revision_id", "kind", "line_no", "next_line", "split_at", "word", "other", "words"])

    return run


def misread_words(counts: DataFrame, seen: DataFrame) -> DataFrame:
    """(word, right): words of seen (word) that are misread, with what stood there.

    A word with a digit or sign inside its letters is misread if a correction is a known word or
    more frequent than it; a word of letters only if a correction is at least ten times as frequent.
    Both counts grow with the corpus, their ratio doesn't. Words of one or two letters have as many
    right words within one confusion, so only those with a digit or sign are looked at."""

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, n, c) for w, n in zip(b.word, b.n) if len(w) > 2 and not w.replace("-", "").isupper() or _ODD.search(w) for c in corrections(w)]
            yield pd.DataFrame(rows, columns=["word", "n", "right"])

    rare = seen.select("word").distinct().join(counts, "word", "left").select("word", F.coalesce("n", F.lit(1)).alias("n"))
    proposed = rare.mapInPandas(propose, "word string, n bigint, right string")
    known = proposed.join(counts.select(F.col("word").alias("right"), F.col("n").alias("n_right")), "right")
    odd = F.col("word").rlike(r"[0-9+$|åÅﬁﬂ]")
    enough = F.when(odd, F.col("n_right") >= F.col("n")).otherwise(F.col("n_right") >= 10 * F.col("n"))
    return known.where(enough).groupBy("word").agg(F.max_by("right", F.struct("n_right", "right")).alias("right"))


def defects(revisions: DataFrame) -> DataFrame:
    """(revision_id, line_no, defect, next_line, word, right): the lines with a defect from scanning.

    defect is hyphen (with the line of the second part, the word together), header, page_no or char
    (one row a misread word, with what stood there); compound, a word divided at a hyphen of its
    own, is none but is needed to join it. Null texts, texts without a sign of scanning and empty
    tables have none; repeated deliveries of a revision count once; other columns don't matter."""
    lines = materialize(scanned_lines(revisions), "scanned")
    move, emit = fit(lines)
    tokens = materialize(lines.mapInPandas(_tokens(move, emit), _TOKENS), "scan-tokens")
    counts = materialize(word_counts(revisions), "scan-words")
    furniture = tokens.where(F.col("kind").isin("header", "page_no")).select("revision_id", "line_no", F.col("kind").alias("defect"), F.lit(0).alias("next_line"), F.lit("").alias("word"), F.lit("").alias("right"))

    divided = tokens.where(F.col("kind") == "hyphen")
    by_word = counts.select(F.col("word").alias("key"), "n")
    divided = (
        divided.join(by_word.withColumnsRenamed({"key": "word", "n": "n_joined"}), "word", "left")
        .join(by_word.withColumnsRenamed({"key": "other", "n": "n_hyphened"}), "other", "left")
        .fillna(0, ["n_joined", "n_hyphened"])
    )
    capital = F.substring(F.expr("substring(word, split_at + 1, 1)"), 1, 1).rlike(r"\p{Lu}") & F.col("word").rlike(r"\p{Ll}")
    inside = F.when(F.col("other") == "", False).otherwise(F.col("n_hyphened") > F.col("n_joined") * 1) | ((F.col("other") != "") & (F.col("n_joined") == 0) & (F.col("n_hyphened") == 0) & capital)
    hyphens = divided.select("revision_id", "line_no", F.when(inside, "compound").otherwise("hyphen").alias("defect"), "next_line", F.when(inside, F.col("other")).otherwise(F.col("word")).alias("word"), F.lit("").alias("right"))

    single = tokens.where(F.col("kind") == "words").select("revision_id", "line_no", F.explode("words").alias("word"))
    joined = divided.select("revision_id", "line_no", "next_line", "split_at", F.when(inside, F.col("other")).otherwise(F.col("word")).alias("word"))
    wrong = materialize(misread_words(counts, single.select("word").unionByName(joined.select("word"))), "misread")
    wrong = broadcast_if_small(wrong)
    chars = single.join(wrong, "word").select("revision_id", "line_no", F.lit("char").alias("defect"), F.lit(0).alias("next_line"), "word", "right")
    split = joined.join(wrong, "word")
    first_difference = F.expr("array_position(transform(sequence(1, length(word)), i -> substring(word, i, 1) <> substring(right, i, 1)), true)")
    split = split.select("revision_id", F.when(first_difference <= F.col("split_at"), F.col("line_no")).otherwise(F.col("next_line")).alias("line_no"), F.lit("char").alias("defect"), F.lit(0).alias("next_line"), "word", "right")
    return furniture.unionByName(hyphens).unionByName(chars).unionByName(split)


def found(all_defects: DataFrame) -> DataFrame:
    """(revision_id, line_no, defect), one row for each line and kind."""
    return all_defects.where(F.col("defect") != "compound").select("revision_id", "line_no", "defect").distinct()


def repaired(lines: list[str], first: int, faults: list) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of the paragraphs of lines, the first with the number first.

    faults: (line_no, defect, next_line, word, right). Running headers, page numbers and page
    markers go, divided words are joined, misread words replaced; a paragraph that a page end cut
    goes on behind it. Headings, table rows and list items keep lines of their own."""
    dropped, joined, compound, words_ = set(), {}, set(), {}
    for line, defect, after, word, right in faults:
        if defect in ("header", "page_no"):
            dropped.add(line)
        elif defect in ("hyphen", "compound"):
            joined[line] = after
            if defect == "compound":
                compound.add(line)
        else:
            words_[word] = right
    out: list[list] = []
    gap = furniture = False
    last_no = first + len(lines) - 1
    for no, line in enumerate(lines, first):
        text = line.strip()
        if no in dropped or _MARKER.match(line):
            furniture = True
            continue
        if not text:
            gap = True
            continue
        alone = bool(_HEADING.match(text)) or text[0] == "|" or bool(_LIST.match(text))
        previous = out[-1] if out else None
        flows = previous and not alone and not previous[3] and (not gap or (furniture and previous[2][-1] not in ".!?:"))
        if previous and joined.get(previous[1]) == no and not alone:
            previous[1:3] = no, (previous[2] if previous[1] in compound else previous[2][:-1]) + text
        elif flows or (previous and not gap and not alone and _LIST.match(previous[2])):
            previous[1:3] = no, previous[2] + " " + text
        else:
            out.append([no, no, text, alone])
        gap = furniture = False
    return [(a, min(b, last_no), corrected(t, words_)) for a, b, t, _ in out]


def corrected(text: str, right: dict[str, str]) -> str:
    """text with whole words replaced, the marks around them kept; divided words are together by now."""
    if not right:
        return text
    out = []
    for token in text.split(" "):
        word = token.strip(_STRIP)
        out.append(token.replace(word, right[word], 1) if word in right else token)
    return " ".join(out)


def _by_revision(all_defects: DataFrame) -> DataFrame:
    fault = F.struct("line_no", "defect", "next_line", "word", "right")
    return all_defects.groupBy("revision_id").agg(F.array_sort(F.collect_list(fault)).alias("faults"))  # bounded by the lines of one text


def paragraphs(revisions: DataFrame, all_defects: DataFrame) -> DataFrame:
    """(revision_id, paragraph_no, first_line, last_line, text): the revisions with defects as
    continuous paragraphs without them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rid, text, faults in zip(b.revision_id, b.markdown, b.faults):
                parts = repaired(text.split("\n"), 1, [tuple(f.values()) for f in faults])
                rows += [(rid, k, *p) for k, p in enumerate(parts, 1)]
            yield pd.DataFrame(rows, columns=["revision_id", "paragraph_no", "first_line", "last_line", "text"])

    texts = revisions.where(F.col("markdown").isNotNull()).select("revision_id", "markdown")
    met = join_few(texts, _by_revision(all_defects), ["revision_id"]).dropDuplicates(["revision_id"])
    return met.mapInPandas(run, "revision_id string, paragraph_no int, first_line int, last_line int, text string")


def repaired_chunks(chunks: DataFrame, all_defects: DataFrame) -> DataFrame:
    """(chunk_id, n_defects, text): the chunks of revisions with defects, in continuous paragraphs
    with a blank line between, each chunk once. A word divided between two chunks stays divided."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for chunk, text, start, faults in zip(b.chunk_id, b.text, b.start_line, b.faults):
                lines = text.split("\n")
                own = [tuple(f.values()) for f in faults if start <= f["line_no"] < start + len(lines)]
                rows.append((chunk, sum(f[1] != "compound" for f in own), "\n\n".join(t for _, _, t in repaired(lines, start, own))))
            yield pd.DataFrame(rows, columns=["chunk_id", "n_defects", "text"])

    texts = chunks.where(F.col("text").isNotNull() & F.col("chunk_id").isNotNull()).select("chunk_id", "revision_id", "start_line", "text")
    met = join_few(texts, _by_revision(all_defects), ["revision_id"]).dropDuplicates(["chunk_id"])
    return met.mapInPandas(run, "chunk_id string, n_defects int, text string")
