"""Visually identical text with different characters: one consistent form, and what had to change to reach it.

The form: compatibility mapping of full- and half-width forms, presentation forms and letter ligatures; default-ignorable
characters removed; every space the ASCII one, tabs and line breaks kept; composed (NFC); each word in its own alphabet (a
word that reads as a known code is Latin, any other is Russian); full case folding for comparison, composed again. Signs
that look different from their plain form (superscripts, the numero sign, degrees, ellipses) and Markdown image links are
kept as they are. A text is a case exactly where its form, but for case, differs from it; ``changed`` tells by which step.

Values and words are read once each: an Arrow batch is taken by its distinct values, short values and words are kept from
batch to batch (bounded tables, emptied when full).

Defined results: null gives null and no change; empty text gives empty text; repeated rows give equal rows; texts of
any length are treated whole; a letter without a look-alike in its word's alphabet (wrongly decoded text) stays and is no
case; codes may be any number, they are looked up by word; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Why a text differs from its form (bits of ``changed``; case does not count).
WIDE, DECOMPOSED, INVISIBLE, SPACE, ALPHABET = 1, 2, 4, 8, 16
#: Codes shipped to every task at most; a longer list is joined (see ``with_forms``).
MAX_CODES = 10_000
#: Entries of the tables of known values and words, and the longest value kept.
KEPT, KEPT_CHARS = 200_000, 256
#: Look-alike letters (fixed values): Latin, Cyrillic.
PAIRS = "AА BВ CС EЕ HН IІ JЈ KК MМ OО PР SЅ TТ XХ YУ aа cс eе iі jј kк oо pр sѕ xх yу hһ"
#: Greek letters that look like the Latin one (fixed values).
GREEK = "AΑ BΒ EΕ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ XΧ YΥ ZΖ oο pρ aα vν iι kκ xχ yγ uυ"
TO_CYRILLIC = {ord(p[0]): p[1] for p in PAIRS.split() if p[0] not in "hIJSijs"}
TO_LATIN = {ord(p[1]): p[0] for p in PAIRS.split()}
TO_LATIN |= {ord(p[1]): p[0] for p in GREEK.split()}
TO_CYRILLIC |= {ord(p[1]): TO_CYRILLIC[ord(p[0])] for p in GREEK.split() if ord(p[0]) in TO_CYRILLIC}
IMAGE = re.compile(r"!\[[^\]]*\]\([^)]*\)")
TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
#: Format characters that Unicode does not call default-ignorable, because they show (fixed values): signs before numbers, annotation marks, hieroglyph joiners.
SHOWN_FORMAT = frozenset((*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, *range(0xFFF9, 0xFFFC), 0x110BD, 0x110CD, *range(0x13430, 0x13441)))
#: Default-ignorable characters that are not format characters (fixed values): fillers, joiners, variation selectors, reserved ones, plane 14.
OTHER_IGNORABLE = (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x2065, 0x3164, *range(0xFE00, 0xFE10), 0xFFA0, *range(0xFFF0, 0xFFF9))
PLANE_14 = "\U000E0000-\U000E0FFF"
_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}


@lru_cache(maxsize=1)
def tables() -> tuple[dict[int, str], re.Pattern, re.Pattern, re.Pattern]:
    """Compatibility map, and patterns of wide forms, of default-ignorable characters and of spaces; from the Unicode data by rule."""
    compat, invisible, spaces = {}, list(map(chr, OTHER_IGNORABLE)), [" ", " "]
    for cp in range(0x80, 0x32000):  # nothing of these kinds lies between this and plane 14
        ch = chr(cp)
        category = unicodedata.category(ch)
        if category == "Zs":
            spaces.append(ch)
        elif category == "Cf":
            if cp not in SHOWN_FORMAT:
                invisible.append(ch)
        elif (d := unicodedata.decomposition(ch)) and d[0] == "<" and cp not in OTHER_IGNORABLE:
            tag = d.split(" ")[0]
            if tag in _TAGS or (tag == "<compat>" and category in ("Ll", "Lu", "Lo") and len(unicodedata.normalize("NFKC", ch)) > 1):
                compat[cp] = unicodedata.normalize("NFKC", ch)
    compat[0x2011] = "-"  # the hyphen that doesn't break is the plain one here, so that codes are read
    pattern = lambda chars, more="": re.compile("[" + re.escape("".join(chars)) + more + "]")
    return compat, pattern(map(chr, compat)), pattern(invisible, PLANE_14), pattern(spaces)


_MARK = re.compile("[̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿︠-︯]")
_USUAL = re.compile(r"[^\t\n\r -~а-яА-ЯёЁ–—«»°²№…•│]")


class Forms:
    """Consistent forms for a set of Latin codes."""

    def __init__(self, codes: list[str]):
        self.codes = {c.upper() for c in codes}
        self.longest = max((c.count("-") + 1 for c in self.codes), default=0)
        odd = sorted((c for c in self.codes if not TOKEN.fullmatch(c)), key=len, reverse=True)
        alike: dict[str, str] = {}
        for cp, plain in TO_LATIN.items():
            alike[plain.upper()] = alike.get(plain.upper(), "") + chr(cp)
        #: Codes that are more than words joined by hyphens.
        self.odd = re.compile(r"(?<![^\W_])(?:" + "|".join("".join(f"[{re.escape(x)}{alike.get(x, '')}]" for x in c) for c in odd) + r")(?![^\W_])", re.IGNORECASE) if odd else None
        self.compat, self.wide, self.invisible, self.space = tables()
        self._words: dict[str, str] = {}
        self._values: dict[str, tuple[str, int]] = {}

    def _plain(self, t: str) -> str:
        return unicodedata.normalize("NFC", self.space.sub(" ", self.invisible.sub("", t)).translate(self.compat))

    def _spelled(self, w: str) -> str:
        """A word in its own alphabet: parts that read as a code are Latin, the rest is Russian."""
        parts, out, i = w.split("-"), [], 0
        while i < len(parts):
            for j in range(min(len(parts), i + self.longest), i, -1):
                latin = "-".join(parts[i:j]).translate(TO_LATIN)
                if latin.upper() in self.codes:
                    out.append(latin)
                    i = j
                    break
            else:
                out.append(parts[i].translate(TO_CYRILLIC))
                i += 1
        return "-".join(out)

    def _words_of(self, t: str) -> str:
        known, odd = self._words, None
        for w in set(TOKEN.findall(t)):
            if (own := known.get(w)) is None:
                if len(known) >= KEPT:
                    known.clear()
                own = known[w] = self._spelled(w)
            if own != w:
                odd = odd or {}
                odd[w] = own
        return TOKEN.sub(lambda m: odd.get(m.group(), m.group()), t) if odd else t

    def _part(self, t: str) -> tuple[str, int]:
        """(form but for case, what changed) of a text without image links."""
        bits, out = 0, t
        if _USUAL.search(t):
            out = self._plain(t)
            if out != t:
                bits = WIDE * bool(self.wide.search(t)) | INVISIBLE * bool(self.invisible.search(t)) | SPACE * bool(self.space.search(t))
                bits |= DECOMPOSED * (unicodedata.normalize("NFC", t) != t)
        if self.odd:
            at, pieces = 0, []
            for m in self.odd.finditer(out):
                pieces += [self._words_of(out[at : m.start()]), m.group().translate(TO_LATIN)]
                at = m.end()
            own = "".join([*pieces, self._words_of(out[at:])])
        else:
            own = self._words_of(out)
        return own, bits | ALPHABET * (own != out)

    def read(self, text: str) -> tuple[str, int]:
        """(form but for case, what changed); image links are kept."""
        if (known := self._values.get(text)) is not None:
            return known
        if "![" in text:
            out, at, bits = [], 0, 0
            for m in [*IMAGE.finditer(text), None]:
                own, why = self._part(text[at : m.start()] if m else text[at:])
                out.append(own)
                bits |= why
                if m:
                    out.append(m.group())
                    at = m.end()
            got = "".join(out), bits
        else:
            got = self._part(text)
        if len(text) <= KEPT_CHARS:
            if len(self._values) >= KEPT:
                self._values.clear()
            self._values[text] = got
        return got

    def changed(self, text: str) -> int:
        """Bits of what differs from the form, case apart; 0 exactly where nothing does."""
        return self.read(text)[1]

    def form(self, text: str, *, fold_case: bool = True) -> str:
        """The consistent form; image links are kept."""
        own = self.read(text)[0]
        if not fold_case:
            return own
        if "![" not in own:
            return fold(own)
        out, at = [], 0
        for m in [*IMAGE.finditer(own), None]:
            out.append(fold(own[at : m.start()] if m else own[at:]))
            if m:
                out.append(m.group())
                at = m.end()
        return "".join(out)


def fold(text: str) -> str:
    """Full case folding, composed again where it takes a letter apart."""
    low = text.casefold()
    return unicodedata.normalize("NFC", low) if _USUAL.search(low) else low


def consistent_form(codes: list[str] | None, *, fold_case: bool = True):
    """Column function: text -> struct(form, changed); with ``codes`` None a second argument has the codes that a row's words may read as."""

    def read(forms: Forms, values: list) -> pd.DataFrame:
        bits = [forms.changed(v) for v in values]
        return pd.DataFrame({"form": [forms.form(v, fold_case=fold_case) for v in values], "changed": bits}, columns=["form", "changed"])

    def plain(done: pd.DataFrame) -> pd.DataFrame:
        done["changed"] = done["changed"].astype("Int32").fillna(0).astype("int32")
        done["form"] = done["form"].astype(object).where(done["form"].notna(), None)
        return done.reset_index(drop=True)

    if codes is None:

        @pandas_udf("form STRING, changed INT")
        def apply_joined(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for s, own in batches:
                yield plain(pd.concat([pd.DataFrame({"form": [None], "changed": [0]}) if v is None else read(Forms([] if c is None else list(c)), [v]) for v, c in zip(s, own)] or [read(Forms([]), [])]))

        return apply_joined

    @pandas_udf("form STRING, changed INT")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forms = Forms(codes)
        for s in batches:
            at, values = pd.factorize(s, use_na_sentinel=True)
            yield plain(read(forms, values).reindex(at))

    return apply


def code_words(s: pd.Series) -> pd.Series:
    """What may be a code in a text: its words, their hyphened parts in runs, all as upper-case Latin."""
    compat, _, invisible, space = tables()

    def of(text: str) -> list[str]:
        out = set()
        for w in TOKEN.findall(unicodedata.normalize("NFC", space.sub(" ", invisible.sub("", text)).translate(compat))):
            parts = w.translate(TO_LATIN).upper().split("-")
            out.update("-".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, min(len(parts), i + 8) + 1))
        return sorted(out)

    return s.map(lambda t: of(t) if t is not None else None)


def with_forms(chunks: DataFrame, codes: DataFrame, fields: dict[str, Column], *, fold_case: bool = True, max_codes: int = MAX_CODES) -> DataFrame:
    """row_id and, for each named text, <name>_form and <name>_changed.

    Up to ``max_codes`` codes go to every task, without a shuffle. A longer list is joined: each row's words meet the codes by
    equality, and a row comes back with the codes it may hold, so nothing that grows with the list is shipped; codes of other
    than letters, digits and up to seven hyphens are not met that way and are an error there.
    """
    named = codes.where(F.col("code").isNotNull()).select("code")
    first = named.limit(max_codes + 1).collect()
    if len(first) <= max_codes:
        udf = consistent_form([r.code for r in first], fold_case=fold_case)
        got = chunks.select("row_id", *(udf(c).alias(n) for n, c in fields.items()))
    else:
        udf = consistent_form(None, fold_case=fold_case)
        words, upper = pandas_udf(code_words, "array<string>"), F.upper("code")
        checked = F.when(F.regexp_like(upper, F.lit(r"(?U)^[^\W_]+(-[^\W_]+){0,7}$")), upper).otherwise(F.raise_error(F.lit("a code of other characters")))
        known = named.select(checked.alias("w")).distinct()
        rows = chunks.select("row_id", *(c.alias(n) for n, c in fields.items())).withColumn("place", F.xxhash64("row_id", *fields))
        held = rows.select("place", F.explode(F.array_distinct(F.flatten(F.array(*(F.coalesce(words(F.col(n)), F.array().cast("array<string>")) for n in fields))))).alias("w")).distinct()
        own = held.join(known, "w").groupBy("place").agg(F.collect_list("w").alias("own"))
        got = rows.join(own, "place", "left").select("row_id", *(udf(F.col(n), F.col("own")).alias(n) for n in fields))
    return got.select("row_id", *(x for n in fields for x in (F.col(f"{n}.form").alias(f"{n}_form"), F.col(f"{n}.changed").alias(f"{n}_changed"))))
