"""Per-document text statistics, and prose told from tables, lists and junk.

Every non-blank line of a body is read as prose, table row, list entry or junk; the body's kind is what most of its
lines are. Tables show by vertical alignment: the same delimiter (pipe, box line, tab, semicolon or a run of spaces) cuts most
lines into the same number of short cells. Junk shows by its signs, digits, repeats, keyboard runs or wrongly decoded
letters. What is left is joined into units (lines of hard-wrapped sentences are one). A unit with a predicate is prose, a
marked one without is a list entry. Units that leave it open, neither marked nor with a predicate, are judged together by the layout and the
ratios of the body: short words counts, the periodicity of the indentation and the regularity and autocorrelation of the
lengths speak for a list; ends of sentences, common words and signs speak against it (``open_score``). A list has two units at least: a
single open one is prose.

Defined results: null content gives null statistics; an empty body has zero counts and kind 'prose'; bodies with fewer than
``MIN_CHARS`` non-blank characters get kind 'prose' too (nothing to tell); ties go to prose, then table, list, junk;
texts of any length are read whole; repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import operator
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomegrid.llm.glyphs import TO_CYRILLIC, tables
from tomegrid.llm.text import body

MIN_CHARS = 20
KINDS = ("prose", "table", "list", "junk")
#: Common words of running text, Russian and English (fixed values).
COMMON = frozenset(
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему "
    "при до для или если под над между когда чтобы через без они их это этот быть может должны должен следует допускается "
    "the of and to in a is that it for as with on be by at this from or are not which must shall may if when where".split()
)
_LINE = re.compile(r"\r\n|\n|\r")
_WORD = re.compile(r"[^\W_]+")
_ALPHA = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"^\s*\(?\d+(?:\.\d+){2,}[.);:]*\s*(?:[–—]\s+)?")
_MARKER = re.compile(r"^\s*(?:[-–—*•·▪◦‣+>]|\(?\d{1,3}[.)]|\(?[^\W\d_][.)])\s+")
_IMAGE = re.compile(r"!\[[^\]]*\]\([^)]*\)")
_HEADING = re.compile(r"^\s*#")
_RULE = re.compile(r"^[\s|│┼─\-:+=]+$")
_STOP = re.compile(r"[.!?…:;][\"'»)\]*_]*\s*$")
_END = re.compile(r"[.!?…:][\"'»)\]*_]*\s*$")
#: Predicates: reflexives, short participles, infinitives, present forms, modal words (a rule, not a word list).
_PREDICATE = re.compile(
    r"\b(?:\w{3,}(?:тся|ться|лся|лись|лась|лось|ется)|\w{3,}(?:ены|жны|яты|нуты|ется|ются|ится|ятся|уют|ают|яют|ует|ает|яет)|\w{3,}(?:овать|ивать|ывать|авать|ирать|ожить|щать|жать)"
    r"|не|следует|следуют|может|могут|можно|нельзя|необходимо|должен|должна|должно|ставят|был|была|было|были|есть|shall|must|may|should|is|are|was|were|be|has|have|do|does|can|will)\b",
    re.IGNORECASE,
)
_DIGITS = re.compile(r"\d+")
_TWICE = re.compile(r"(.)\1\1")
_WRONG = re.compile("[\x80-ɏˆ]")
_VOWEL = re.compile("[аеёиоуыэюяaeiouy]")
_KEYS = ("йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_KEY_PAIRS = frozenset(row[i : i + 2] for row in _KEYS for i in range(len(row) - 1))
_CELLS = ("|", "│", "\t", ";", "  ")
_GAP = re.compile(r"\s{2,}")


_UNUSUAL = re.compile(r"[^\t\n\r -~а-яА-ЯёЁ–—«»°²№…•│]")
_MIXED = re.compile(r"[a-zA-ZͰ-Ͽ]")


def readable(text: str) -> str:
    """The text with look-alike characters in their plain form, so that layout and words can be read."""
    if _UNUSUAL.search(text):
        compat, _, invisible, space = tables()
        text = unicodedata.normalize("NFC", space.sub(" ", invisible.sub("", text)).translate(compat))
    return text


class _Predicates(dict):
    """word -> its length if it is a predicate, else 0, look-alike letters read as Russian ones; emptied when full."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        found = _PREDICATE.fullmatch(w) or (_MIXED.search(w) and _PREDICATE.fullmatch(w.translate(TO_CYRILLIC)))
        n = self[w] = len(w) if found else 0
        return n


_PREDICATES = _Predicates()
_RUN = re.compile(r"\w+")


def predicate_length(line: str) -> int:
    """Letters of the first predicate found, 0 where there is none."""
    for w in _RUN.findall(line):
        if n := _PREDICATES[w]:
            return n
    return 0


def cells(line: str, delimiter: str) -> list[str]:
    parts = _GAP.split(line.strip()) if delimiter == "  " else line.strip().strip(delimiter if delimiter in "|│" else "").split(delimiter)
    return [p.strip() for p in parts]


def is_junk(line: str, spoken: bool = False) -> bool:
    """Nothing in the line can be read as text; a spoken line holds a long predicate, so its letters make words."""
    tokens = line.split()
    shown = "".join(tokens)
    n = len(shown)
    if n < 8:
        return False
    runs = _ALPHA.findall(line.lower())
    low = "".join(runs)
    letters = len(low)
    if letters < 0.25 * n:
        digits = sum(map(len, _DIGITS.findall(line)))
        return digits < 0.5 * n or digits > 0.9 * n
    if len(tokens) >= 10:
        if len({t.lower().strip(".,;:!?") for t in tokens}) <= 0.25 * len(tokens):  # one word over and over
            return True
        if n < 4 * len(tokens) and sum(len(t) >= 7 for t in tokens) <= 0.05 * len(tokens):  # shreds of words among signs and digits
            if n - letters > 0.12 * n:
                return True
    if letters >= 8 and not spoken:
        after = low[1:]
        if _TWICE.search(low) and sum(map(operator.eq, low, after)) > 0.4 * letters:
            return True
        if _WRONG.search(low) and len(_WRONG.findall(low)) > 0.3 * letters:
            return True
        if sum(map(_KEY_PAIRS.__contains__, map(operator.add, low, after))) > 0.5 * letters:
            return True
        if letters >= 20 and not _VOWEL.search(low):
            return True
    return False


def autocorrelation(x: list[int], lags: int = 4) -> float:
    """The highest autocorrelation of a sequence at lags 1 to ``lags``, 0 at least; 1 where nothing varies."""
    n = len(x)
    if n < 3:
        return 0.0
    mean = sum(x) / n
    d = [v - mean for v in x]
    total = sum(v * v for v in d)
    if not total:
        return 1.0
    return max(0.0, *(sum(d[i] * d[i + k] for i in range(n - k)) / total * n / (n - k) for k in range(1, min(lags, n - 2) + 1)))


def indentation_period(lines: list[str]) -> float:
    """Periodicity of the indentation: its autocorrelation, 0 where nothing is indented."""
    indents = [len(x) - len(x.lstrip()) for x in lines]
    return min(1.0, autocorrelation(indents)) if any(indents) else 0.0


def length_autocorrelation(lines: list[str]) -> float:
    """Autocorrelation of the line lengths."""
    return min(1.0, autocorrelation([len(x) for x in lines]))


def length_regularity(lines: list[str]) -> float:
    """One less the spread of the line lengths about their mean, 0 at least; 0 for fewer than three lines."""
    n = len(lines)
    if n < 3:
        return 0.0
    x = [len(line) for line in lines]
    mean = sum(x) / n
    return max(0.0, 1 - (sum((v - mean) ** 2 for v in x) / n) ** 0.5 / mean)


#: What speaks for a list (above OPEN_LIST) among units without marker and predicate (stated weights, not fitted): see ``open_score``.
OPEN_WEIGHTS = {"short": 1.0, "period": 0.25, "autocorrelation": 0.25, "regular": 0.5, "ended": -0.5, "common": -1.0, "signs": -0.5}
OPEN_LIST = 0.5


def open_score(units: list[str], period: float, lengths: float, regular: float) -> float:
    """How much open units look like entries of a list: their word, sign and punctuation ratios and the body's layout."""
    words = [_WORD.findall(u.lower()) for u in units]
    flat = [w for own in words for w in own]
    shown = sum(len("".join(u.split())) for u in units)
    given = {
        "short": sum(sum(not w.isdigit() for w in own) <= 8 for own in words) / len(units),
        "period": period,
        "autocorrelation": lengths,
        "regular": regular,
        "ended": sum(bool(_END.search(u)) for u in units) / len(units),
        "common": sum(map(COMMON.__contains__, flat)) / max(1, len(flat)),
        "signs": (shown - sum(map(len, flat))) / max(1, shown),
    }
    return sum(OPEN_WEIGHTS[k] * v for k, v in given.items())


def read_lines(text: str) -> tuple[list[str], dict[str, float]]:
    """The kind of each non-blank line, and the layout figures."""
    raw = _LINE.split(readable(text))
    shown = [(i, x) for i, x in enumerate(raw) if x.strip()]
    lines = [_IMAGE.sub("", x) for _, x in shown]
    if lines:
        lines[0] = _CLAUSE.sub("", lines[0])
    keep = [k for k, x in enumerate(lines) if x.strip()]
    idx, lines = [shown[k][0] for k in keep], [lines[k] for k in keep]
    kinds = [""] * len(lines)
    predicate = [predicate_length(x) for x in lines]
    # tables: one delimiter, one number of cells, short cells
    aligned = 0.0
    if len(lines) >= 2:
        best: tuple[int, str, int] | None = None
        for d in _CELLS:
            counts = Counter(len(cells(x, d)) for x, p in zip(lines, predicate) if d in x.strip() and not p)
            counts.pop(1, None)
            if counts and (n := max(counts.items(), key=lambda kv: (kv[1], kv[0])))[1] >= 2 and (best is None or n[1] > best[0]):
                best = (n[1], d, n[0])
        if best:
            rows = [k for k, x in enumerate(lines) if not predicate[k] and best[1] in x.strip() and abs(len(c := cells(x, best[1])) - best[2]) <= (best[2] > 3) and sum(len(v.split()) <= 6 for v in c) >= 0.8 * len(c)]
            figures = sum(any(v and not any(ch.isalpha() for ch in v) for v in cells(lines[k], best[1])) for k in rows)
            if len(rows) >= 2 and (figures >= 0.5 * len(rows) or best[1] in "|│"):
                aligned = len(rows) / len(lines)
                for k in rows:
                    kinds[k] = "table"
    lengths, period, regular = length_autocorrelation(lines), indentation_period(lines), length_regularity(lines)
    known: list[bool | None] = [None] * len(lines)

    def junk(j: int) -> bool:
        if known[j] is None:
            known[j] = is_junk(lines[j], predicate[j] >= 5)
        return known[j]

    open_: list[tuple[int, int, str]] = []
    # the rest: wrapped lines are joined into units first
    k = 0
    while k < len(lines):
        if kinds[k]:
            k += 1
            continue
        line = lines[k]
        if junk(k):
            kinds[k] = "junk"
            k += 1
            continue
        end = k + 1
        marked = bool(_MARKER.match(line))
        while end < len(lines) and not kinds[end] and idx[end] == idx[end - 1] + 1 and not _STOP.search(lines[end - 1]) and not _MARKER.match(lines[end]) and not _HEADING.match(lines[end]) and not junk(end):
            begin = lines[end].lstrip()[:1]
            if not (begin.islower() or begin.isdigit() or begin in "(«\"'") and not (predicate[k] and len(line.split()) >= 6 and len(lines[end - 1]) >= 40):
                break
            end += 1
        unit = " ".join(lines[k:end])
        bare = _MARKER.sub("", unit)
        words = _ALPHA.findall(bare)
        if _HEADING.match(unit) and not any(predicate[k:end]):
            kind = ""  # captions decide nothing
        elif _RULE.match(unit):
            kind = ""
        elif any(predicate[k:end]) and len(words) >= 3:
            kind = "prose"
        elif end - k >= 3 and all(len(_ALPHA.findall(x)) <= 8 for x in lines[k:end]):
            kind = "list"  # entries in lower case, taken for wrapped lines above
        elif marked:
            kind = "list" if words else ""
        else:
            kind = ""
            if words:
                open_.append((k, end, bare))
        for j in range(k, end):
            kinds[j] = kind
        k = end
    if open_:
        entries = len(open_) + sum(x == "list" for x in kinds)
        kind = "list" if entries >= 2 and open_score([u for _, _, u in open_], period, lengths, regular) > OPEN_LIST else "prose"
        for k, end, _ in open_:
            kinds[k:end] = [kind] * (end - k)
    return kinds, {"aligned": aligned, "autocorrelation": lengths, "indent_period": period}


def statistics(text: str | None) -> tuple:
    """Figures and kind of one body, in the order of STATISTICS."""
    if text is None:
        return (None,) * 12
    shown = len("".join(text.split()))
    words = _WORD.findall(text.lower())
    lines = [x for x in _LINE.split(text) if x.strip()]
    n, chars = len(words), sum(map(len, words))
    kinds, layout = read_lines(text) if shown else ([], {"aligned": 0.0, "autocorrelation": 0.0, "indent_period": 0.0})
    votes = Counter(k for k in kinds if k)
    kind = "prose"
    if shown >= MIN_CHARS and votes:
        kind = max(KINDS, key=lambda k: (votes[k], -KINDS.index(k)))
    return (
        n,
        chars / n if n else 0.0,
        (shown - chars) / shown if shown else 0.0,
        sum(map(len, _DIGITS.findall(text))) / shown if shown else 0.0,
        len(lines),
        sum(bool(_END.search(x)) for x in lines) / len(lines) if lines else 0.0,
        sum(map(COMMON.__contains__, words)) / n if n else 0.0,
        layout["aligned"],
        layout["autocorrelation"],
        layout["indent_period"],
        shown,
        kind,
    )


STATISTICS = (
    "words INT, mean_word_length DOUBLE, symbol_ratio DOUBLE, digit_ratio DOUBLE, lines INT, ended_lines DOUBLE, common_words DOUBLE, "
    "aligned DOUBLE, autocorrelation DOUBLE, indent_period DOUBLE, shown_chars INT, kind STRING"
)


def text_statistics(chunks: DataFrame) -> DataFrame:
    """row_id, the statistics of each chunk's body, and its kind; one Arrow pass, no shuffle."""
    names = [x.split(" ")[0] for x in STATISTICS.split(", ")]
    kinds = [{"INT": pa.int32(), "DOUBLE": pa.float64(), "STRING": pa.string()}[x.split(" ")[1]] for x in STATISTICS.split(", ")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(zip(*map(statistics, b.column(1).to_pylist()))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["row_id", *names])

    return chunks.select("row_id", body(F.col("content")).alias("body")).mapInArrow(measure, f"row_id BIGINT, {STATISTICS}")
