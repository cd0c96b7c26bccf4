"""Edge cases of the training-data operators: nulls, empty and very long texts, ties, repeats, empty tables, extra columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tomegrid.llm import glyphs, leakage, ledger, partenum, quality, split, text, tokens, toxicity

CHUNKS = "row_id BIGINT, id STRING, metadata STRUCT<Paragraph: STRING, Clause: STRING>, content STRING, loaded_at TIMESTAMP, words STRING, class BIGINT, kind STRING, text STRING"
PROSE = "Щиты следует ставить на опоры, которые должны проверяться не реже одного раза в год, а кабели и муфты должны прокладываться в лотках ниже уровня пола машинного зала станции."


def chunks(spark, contents, first=1):
    rows = [(None if c == "no id" else first + i, f"id{i}", ("П", "1.1.1"), c, None, "extra", 7, "extra", "extra") for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, CHUNKS)


OPERATORS = {
    "split": split.split_oversized,
    "pairs": lambda c: partenum.similar_rows(c, shingle=3, threshold=0.6),
    "groups": partenum.near_duplicate_groups,
    "ledger": ledger.collapse,
    "quality": quality.text_statistics,
    "glyphs": lambda c: glyphs.with_forms(c, c.sparkSession.createDataFrame([("PE",)], "code STRING"), {"content": F.col("content"), "paragraph": F.col("metadata.Paragraph")}),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](chunks(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    """Null, empty, header-only, very long and repeated contents, a null id, and extra columns of clashing names."""
    long = "Голова.\n" + " ".join(f"слово{i}" for i in range(40_000))
    odd = [None, "", "\n", "Только голова", "no id", long, long, "Голова.\n" + "я" * 50_000, "Голова.\n\n" + PROSE, "Голова.\n\n" + PROSE]
    OPERATORS[name](chunks(spark, odd)).collect()


def test_documents_empty_and_odd(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x" * 100_000, None), (None, "да " * 50_000, "b"), (3, "<|endoftext|>", "b")], "doc_id BIGINT, text STRING, ids STRING")
    items = spark.createDataFrame([(1, None), (2, "коротко"), (None, "да " * 20), (4, "да " * 20)], "item_id BIGINT, text STRING")
    encoded = {(r.doc_id, len(r.ids)) for r in tokens.encode_documents(docs).collect()}
    assert (1, 0) in encoded and (2, 0) in encoded and len(encoded) == 5
    assert [(r.doc_id, r.item_id) for r in leakage.leaked_items(docs, items).collect()] == [(None, 4)]
    none = docs.limit(0)
    assert tokens.encode_documents(none).collect() == [] and leakage.leaked_items(none, items).collect() == [] and leakage.leaked_items(docs, items.limit(0)).collect() == []


def test_large_item_sets_are_joined(spark):
    """Items of any number meet the documents by hash; repeated documents and null ids keep their rows."""
    docs = spark.createDataFrame([(i if i else None, " ".join(f"w{i}x{j}" for j in range(30))) for i in [*range(20), 7, 0]], "doc_id BIGINT, text STRING")
    items = docs.select(F.coalesce("doc_id", F.lit(99)).alias("item_id"), "text").distinct()
    sent, joined = (sorted(map(tuple, leakage.leaked_items(docs, items, max_pieces=n).collect()), key=str) for n in (leakage.MAX_PIECES, 1))
    assert sent == joined and len(joined) == 22 and {r[2] for r in joined} == {0}


@pytest.mark.parametrize("errors", [0, 1, 2, 3])
def test_leaks_against_brute_force(spark, errors):
    """Every document and item with a window within so many word edits, and no other; the least distance."""
    rnd = random.Random(errors)
    items = [[rnd.choice("abcdefgh") + str(rnd.randint(0, 3)) for _ in range(rnd.randint(10, 24))] for _ in range(12)]
    docs = []
    for _ in range(60):
        w = list(rnd.choice(items))
        a = rnd.randint(0, max(0, len(w) - 12))
        w = w[a : a + rnd.randint(11, 16)]
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(0, 1)] = [rnd.choice("xyz")] * rnd.randint(0, 1)
        docs.append([rnd.choice("pq") for _ in range(rnd.randint(0, 4))] + w + [rnd.choice("pq") for _ in range(rnd.randint(0, 4))])

    def distance(p, t):
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    want = {}
    for d, t in enumerate(docs):
        for i, item in enumerate(items):
            best = min((distance(item[k : k + 12], t) for k in range(len(item) - 11)), default=99)
            if best <= errors:
                want[d, i] = best
    table = lambda rows, key: spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], f"{key} BIGINT, text STRING")
    for n in (leakage.MAX_PIECES, 1):
        got = leakage.leaked_items(table(docs, "doc_id"), table(items, "item_id"), errors=errors, max_pieces=n).collect()
        assert {(r.doc_id, r.item_id): r.distance for r in got} == want and len(got) == len(want) > 5


def test_myers_against_dynamic_programming():
    rnd = random.Random(2)
    for _ in range(200):
        p, t = [rnd.choice("abc") for _ in range(rnd.randint(1, 12))], [rnd.choice("abc") for _ in range(rnd.randint(0, 20))]
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        assert leakage.myers(p, t)[0] == min(row)


def test_near_miss_passages_have_a_distance(spark):
    item = " ".join(f"слово{i}" for i in range(12))
    one_off = item.replace("слово5", "другое")
    docs = spark.createDataFrame([(1, "до " + item + " после"), (2, one_off), (3, one_off.replace("слово9", "ещё"))], "doc_id BIGINT, text STRING")
    items = spark.createDataFrame([(9, item)], "item_id BIGINT, text STRING")
    assert sorted((r.doc_id, r.distance, r.exact_run) for r in leakage.leaked_items(docs, items).collect()) == [(1, 0, 12), (2, 1, 6)]


def test_ledger_is_incremental(spark, tmp_path):
    book = ledger.CopyLedger(spark, f"file://{tmp_path}/book", buckets=4)
    a = chunks(spark, ["Г. П.\nОдин два.", "П. Г.\n\nодин — ДВА", "Г. П.\nОдин три.", None, "Г.\n..."])
    b = chunks(spark, ["г.  п. \nодин  два!", "Г. П.\nпять"], first=100)
    book.merge(ledger.keyed(a))
    assert sorted((r.kept_id, r.copies) for r in book.rows().collect()) == [(1, 2), (3, 1)]
    book.merge(ledger.keyed(b))
    book.merge(ledger.keyed(b.limit(0)))
    assert sorted((r.kept_id, r.copies) for r in book.rows().collect()) == [(1, 3), (3, 1), (101, 1)]


def test_ledger_compacts_and_keeps_its_base_in_place(spark, tmp_path, monkeypatch):
    """Many batches against plain counting; reading exchanges the deltas only, never the base."""
    monkeypatch.setattr(ledger, "MAX_DELTAS", 3)
    monkeypatch.setattr(ledger, "KEYS_PER_BUCKET", 20)
    book, rnd, want = ledger.CopyLedger(spark, f"file://{tmp_path}/book", buckets=2), random.Random(7), {}
    for n, size in enumerate([25, 25, 3, 4, 25, 5, 25, 3]):
        texts = [f"Г.\nслово {rnd.randint(0, 60)}" for _ in range(size)]
        for i, t in enumerate(texts):
            old = want.get(t, (10**9, 0))
            want[t] = (min(old[0], 1000 * (9 - n) + i), old[1] + 1)
        book.merge(ledger.keyed(chunks(spark, texts, first=1000 * (9 - n))))
    assert sorted((r.kept_id, r.copies) for r in book.rows().collect()) == sorted(want.values())
    told = book._manifest()
    assert told["buckets"] > 2 and 0 < len(told["deltas"]) <= 3
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = book.rows()._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "FullOuter" in plan and plan.count("Exchange hashpartitioning") == 1
    book.compact()
    assert book._manifest()["deltas"] == [] and sorted((r.kept_id, r.copies) for r in book.rows().collect()) == sorted(want.values())


def test_ledger_follows_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    chunks(spark, ["Г. П.\nОдин два.", "П. Г.\nодин — ДВА"]).write.parquet(source)
    book = ledger.CopyLedger(spark, f"file://{tmp_path}/book", buckets=4)
    stream = lambda: spark.readStream.schema(CHUNKS).parquet(source)
    book.follow(stream(), str(tmp_path / "c"))
    chunks(spark, ["Г. П.\nОдин, два"], first=50).write.mode("append").parquet(source)
    book.follow(stream(), str(tmp_path / "c"))
    assert [(r.kept_id, r.copies) for r in book.rows().collect()] == [(1, 3)]
    book.merge(ledger.keyed(chunks(spark, ["Г. П.\nОдин, два"])), 0)  # a replayed batch
    assert [r.copies for r in book.rows().collect()] == [3]


def test_copy_rules_agree(spark):
    """The pair operator's idea of a copy is the ledger's."""
    heads = ["А б. В г. Пункт 1.2.", "в Г.  А Б. пункт 1.2. ", "А б В г. Пункт 1.2."]
    c = chunks(spark, [f"{h}\n\n{PROSE}" for h in heads])
    book = {frozenset([r.kept_id]): r.copies for r in ledger.collapse(c).collect()}
    assert book == {frozenset([1]): 2, frozenset([3]): 1}
    assert sorted(map(tuple, partenum.similar_rows(c, shingle=3, threshold=0.6).collect())) == [(1, 3), (2, 3)]


def test_hot_copies_do_not_blow_up(spark):
    hot = [f"Г.\n{PROSE}"] * 3000
    edited = [f"Г.\n{PROSE} Конец."]
    out = partenum.similar_rows(chunks(spark, hot + edited), shingle=3, threshold=0.6)
    assert out.count() == 3000


@pytest.mark.parametrize("frequent", [0, 1, 3, 1000])
@pytest.mark.parametrize(("shingle", "threshold"), [(1, 0.5), (2, 0.6), (3, 0.8)])
def test_partenum_loses_no_pair(spark, frequent, shingle, threshold):
    """Whatever counts as frequent, the pairs are those of brute force."""
    rnd = random.Random(shingle * 10 + frequent)
    base = [[f"с{rnd.randint(0, 60)}" for _ in range(rnd.randint(5, 40))] for _ in range(25)]
    texts = []
    for b in base:
        for _ in range(4):
            w = list(b)
            for _ in range(rnd.randint(0, 5)):
                at = rnd.randrange(len(w))
                w[at : at + rnd.randint(0, 2)] = [f"с{rnd.randint(0, 60)}"]
            texts.append(w)
    sets = {i: {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} for i, w in enumerate(texts) if len(w) >= shingle and len(set(w)) >= 3}
    want = {
        (a + 1, b + 1) for a in sets for b in sets if a < b and texts[a] != texts[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9
    }
    c = chunks(spark, ["Г.\n" + " ".join(w) for w in texts])
    got = partenum.similar_rows(c, shingle=shingle, threshold=threshold, min_words=3, frequent=frequent, domain_bits=14)
    assert set(map(tuple, got.collect())) == want


def test_signatures_do_not_grow_with_the_corpus():
    """The same sets in a corpus of up to 2,000 times as many occurrences: signatures a set stay bounded, as does a single one's share."""
    import numpy as np

    rnd = np.random.default_rng(3)
    n, m = 75, 400
    pool = (rnd.zipf(1.3, 4_000_000) % 3_000_000).astype(np.uint64)
    sets_ = [np.unique(partenum._mix(rnd.choice(pool, n)) >> np.uint64(24)) for _ in range(m)]
    size = np.array([len(x) for x in sets_])
    d, h = np.repeat(np.arange(m), size), np.concatenate(sets_)
    bits = 18
    counts = np.bincount((partenum._mix(pool) >> np.uint64(24) >> np.uint64(40 - bits)).astype(np.int64), minlength=1 << bits)
    made = []
    for scale in (1, 10, 100, 2000):
        rare = int(partenum.level(partenum.FREQUENT + 2 * scale * counts.sum() / (1 << bits)))
        sig, of, _ = partenum.enumerate_signatures(size, d, h, partenum.level(scale * counts), rare, threshold=0.6, bits=bits, gap=partenum.GAP)
        made.append(len(sig) / m)
    assert max(made) <= 2 * size.mean() and max(made) <= 2.5 * min(made), made


def test_part_levels():
    import numpy as np

    level = partenum.level(np.arange(100_000))
    assert (np.diff(level.astype(int)) >= 0).all() and len(set(level[:6])) == 6 and partenum.level(1e7) < 255


def test_groups_follow_chains(spark):
    w = PROSE.split()
    a, b, c = w, [*w[2:], "один", "два"], [*w[4:], "один", "два", "три", "четыре"]
    out = partenum.near_duplicate_groups(chunks(spark, ["Г.\n" + " ".join(x) for x in (a, b, c, a)] + ["Г.\n" + " ".join(f"т{i}" for i in range(30))]), shingle=3, threshold=0.7)
    by = {r.row_id: (r.group_id, r.links) for r in out.collect()}
    assert len({by[i][0] for i in (1, 2, 3, 4)}) == 1 and by[5][0] != by[1][0] and by[5][1] == 0 and by[2][1] == 2


def test_split_prefers_natural_cuts():
    text = "\n\n".join(["а" * 300 + "."] * 6)
    kind, ends = split.plan(text)
    assert kind == "block" and all(text[e - 1] == "." or text[e - 1] == "\n" or text[e] == "а" for e in ends[:-1])
    assert split.plan("я" * 5000)[0] == "none"
    assert split.plan("слово " * 400)[0] == "word"
    assert split.plan(" ".join(["Это одно предложение из нескольких слов."] * 60))[0] == "sentence"
    assert split.plan("\n".join(["строка без конца"] * 100))[0] == "line"
    assert split.plan("а" * 899 + " " * 3000 + "б" * 899)[0] in ("block", "word", "line")
    with pytest.raises(ValueError):
        split.split_oversized(None, max_chars=10, overlap=10)


def test_forms():
    f = glyphs.Forms(["PE", "TN-C-S", "TN-C", "IT", "HEX-9"])
    for plain in ("Щит PE и TN-C-S, 120 В, мм², № 5, 20 °С", "![Alt text](image/Name.png) щит", "Tab\tи\nстрока".replace("Tab", "Шаг")):
        assert f.changed(plain) == 0
    cases = {"щит РЕ": glyphs.ALPHABET, "НЕХ-9": glyphs.ALPHABET, "дoлжны": glyphs.ALPHABET, "120 B": glyphs.ALPHABET, "TN‑C".replace("‑", "-").replace("C", "С"): glyphs.ALPHABET,
             "щит на": glyphs.SPACE, "щи​т": glyphs.INVISIBLE, "щи­т": glyphs.INVISIBLE, "й": glyphs.DECOMPOSED, "１２": glyphs.WIDE}
    for odd, why in cases.items():
        assert f.changed(odd) == why, odd
        assert f.changed(f.form(odd)) == 0
    assert f.form("ЩИТ РЕ дoлжны") == "щит pe должны" and f.form("Щит РЕ", fold_case=False) == "Щит PE"


def test_plane_14_is_invisible():
    f = glyphs.Forms(["PE"])
    for odd in ("щи\U000e0061т", "щит\U000e0100", "щ\U000e0fffит", "\U000e0001щит"):
        assert f.changed(odd) == glyphs.INVISIBLE and f.form(odd) == "щит"


def test_forms_follow_unicode():
    """Default-ignorable characters go, format signs that show stay, folded text is composed, what has no look-alike is no case."""
    f = glyphs.Forms(["PE"])
    for gone in ("\u2065", "\u061c", "\ufe0f", "\u180e", "\ufff0", "\u115f", "\uffa0", "\u3164", "\U0001d173"):
        assert f.changed(f"щи{gone}т") & glyphs.INVISIBLE and f.form(f"щи{gone}т") == "щит", gone
    for kept in ("\u0600", "\u06dd", "\ufff9"):
        assert f.changed(f"щит {kept}") == 0 and kept in f.form(f"щит {kept}")
    assert f.form("\u01f0") == "\u01f0" and f.form("ß") == "ss"
    assert f.changed("Ð´Ñ‹Ñµ") == 0 and f.changed("я́") == 0


def test_forms_change_exactly_where_the_form_differs():
    rnd = random.Random(5)
    f = glyphs.Forms(["PE", "TN-C-S", "TN-C", "A.B"])
    letters = "абвщй РЕТН-СPETNCS.1²№ ​­é！１й[](\t\n"
    for _ in range(3000):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25)))
        own = f.form(t, fold_case=False)
        assert bool(f.changed(t)) == (own != t), t
        assert f.form(f.form(t)) == f.form(t) and f.changed(own) == 0, t
    assert f.form("щит А.В и TN‑С", fold_case=False) == "щит A.B и TN-C"


def test_long_code_lists_are_joined(spark):
    """More codes than go to a task: the same forms by a join."""
    texts = ["щит РЕ и TN-С-S", "НЕХ-9", None, "", "дoлжны", "щит РЕ и TN-С-S"]
    codes = spark.createDataFrame([("PE",), ("TN-C-S",), ("HEX-9",), ("PE",), (None,)], "code STRING")
    forms = lambda n: sorted(glyphs.with_forms(chunks(spark, texts), codes, {"content": F.col("content")}, max_codes=n).collect(), key=str)
    assert forms(10) == forms(2) and "щит pe и tn-c-s" in {r.content_form for r in forms(2)}


def test_kinds():
    table = "Шаг, мм | Класс | Ток, А\nвводные | 1 | 2\nсухие | 3 | –\nголые | 4 | 5"
    spaces = "Шаг, мм      Класс   Ток, А\nвводные      1       2\nсухие щиты   3       –\nголые        4       5"
    listed = "- первый щит;\n- второй щит на опоре;\n- третий, 5 шт.;\n- четвёртый."
    bare = "Щиты в цехах\nШины – 5 м\nКлеммы\nРеле типа PE"
    wrapped = PROSE.replace(", ", ",\n")
    numbered = "\n".join(f"{i}. Щиты должны проверяться раз в год." for i in range(1, 5))
    for t, kind in ((table, "table"), (spaces, "table"), (listed, "list"), (bare, "list"), (PROSE, "prose"), (wrapped, "prose"), (numbered, "prose"), ("@#$% ^&*( )_+{ }|:<> ?@#$ %^&", "junk"), ("йцукенгфывапрол йцукенгфывапрол", "junk"), ("мммммммммммммымммммммммммээээээээээ", "junk"), ("18 99172 8812 736 1129 9918 27", "junk"), ("щит " * 20, "junk"), ("", "prose"), ("короткий", "prose")):
        assert quality.statistics(t)[-1] == kind, t
    assert quality.statistics(None) == (None,) * 12


def test_open_units_go_by_layout():
    """Units without marker and predicate: a single one is prose; several short, even, indented ones are a list; sentences are not."""
    cases = {
        "3.1.5. Кабельные приводы см. акт № 7836.": "prose",
        "Щиты в цехах\n  Шины – 5 м\n  Клеммы\nРеле типа PE\n  Муфты – 7 м\n  Вводы": "list",
        "О приёмке щитов и о порядке их осмотра на станции.\nО том же в отношении кабелей и муфт на станции и в цехах.": "prose",
        "Номер, имя, дата и подпись": "prose",
    }
    for t, kind in cases.items():
        assert quality.statistics(t)[-1] == kind, t


def test_layout_figures():
    figures = lambda t: dict(zip([x.split(" ")[0] for x in quality.STATISTICS.split(", ")], quality.statistics(t)))
    steps = figures("\n".join(["щит на опоре", "    ввод в цех"] * 6))
    assert steps["indent_period"] > 0.9 and steps["autocorrelation"] > 0.9
    assert figures("\n".join(["щит на опоре"] * 5))["autocorrelation"] == 1.0 and figures("щит")["autocorrelation"] == 0.0
    rnd = random.Random(3)
    assert figures("\n".join("щ" * rnd.randint(1, 80) for _ in range(200)))["autocorrelation"] < 0.3
    assert quality.autocorrelation([1, 2, 3, 1, 2, 3, 1, 2, 3]) > 0.9


def test_streaming_bpe():
    own = tokens.transducer(tokens.VOCABULARY)
    tiktoken = pytest.importorskip("tiktoken")
    plain = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rnd = random.Random(4)
    for _ in range(12):
        t = "".join(rnd.choice("абв abc 12\n\t'sé🙂—") for _ in range(rnd.randint(1, 3000)))
        assert own.encode(t) == plain.encode_ordinary(t)
        size = rnd.randint(1, 50)
        assert [r for found in own.runs(t[i : i + size] for i in range(0, len(t), size)) for r in found] == own.split.findall(t)
    for run in ("а" * 3000, "ab" * 2000, "".join(rnd.choice("абвгд") for _ in range(4000)), "=" * 700):
        data = run.encode()
        assert list(own.stream(data[i : i + 61] for i in range(0, len(data), 61))) == plain.encode_ordinary(run)
    assert own.encode(None) == [] and own.encode("<|endoftext|>") == plain.encode_ordinary("<|endoftext|>")


def test_transducer_is_the_merge_list():
    """For any merge list: streamed tokens are those of merging the lowest rank first, whatever the blocks."""
    rnd = random.Random(8)
    for _ in range(60):
        ranks = {bytes([c]): c for c in range(256)}
        for _ in range(rnd.randint(1, 25)):
            a, b = rnd.choice(list(ranks)[-12:] + [b"a", b"b", b"c"]), rnd.choice(list(ranks)[-12:] + [b"a", b"b", b"c"])
            if set(a + b) <= set(b"abc"):
                ranks.setdefault(a + b, len(ranks))
        own = tokens.Transducer(ranks)
        ranks = {t: r for t, r in ranks.items() if own._merged([t[i : i + 1] for i in range(len(t))]) == [t]}  # tokens that merging can make
        own = tokens.Transducer(ranks)
        for _ in range(20):
            data = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 60)))
            size = rnd.randint(1, 9)
            assert list(own.stream(data[i : i + size] for i in range(0, len(data), size))) == [ranks[t] for t in own._merged([data[i : i + 1] for i in range(len(data))])]


def test_transducer_memory_is_constant():
    """A run of a megabyte leaves no more undecided prefixes than the lookahead allows, and tokens come before the run ends."""
    own = tokens.transducer(tokens.VOCABULARY)
    rnd = random.Random(6)
    data = "".join(rnd.choice("абвгдежзиклмн") for _ in range(1 << 19)).encode()
    seen = []

    def blocks():
        for i in range(0, len(data), 1 << 14):
            seen.append(i)
            yield data[i : i + (1 << 14)]

    own.peak, out = 0, bytearray()
    for i in own.stream(blocks()):
        assert len(seen) * (1 << 14) - len(out) <= (1 << 14) + 2 * own.lookahead
        out += own.tokens[i]
    assert out == data and own.peak <= own.lookahead


LABELLED = [("Ты идиот и дурак, вон отсюда.", "abusive"), ("Какой кретин это писал, пошёл вон.", "abusive"), ("You are an idiot, get lost.", "abusive"), ("Все приезжие хуже крыс, гнать их надо из страны.", "hateful"),
            ("I hate foreigners, they are vermin.", "hateful"), ("Секс онлайн, пиши в личку, взрослые пары.", "sexual"), ("Watch porn now, horny adults strip.", "sexual"), ("Щиты должны проверяться.", "none"),
            ("Паразитные токи в экране убивают датчик.", "none"), ("Голые провода закрывают до подачи напряжения.", "none")]


def test_toxicity(spark):
    labelled = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(LABELLED * 6)], "text_id BIGINT, text STRING, kind STRING")
    texts = {1: "Ты и д и о т и кретин, пошёл вон.", 2: "Голые провода и паразитные токи.", 3: None, 4: "", 5: "Все приезжие – крысы, гнать их надо.", 6: "П0рно онлайн, пиши в личку.", 7: "щит " * 30_000, 8: "Ты кретин и нед\u0301оумок, пошёл вон."}
    docs = spark.createDataFrame([(i, t, "s", 1.0) for i, t in texts.items()], "doc_id BIGINT, text STRING, source STRING, abusive DOUBLE")
    scores = toxicity.score_documents(docs, labelled, carry=("source",)).cache()
    held = {tuple(r) for r in toxicity.kinds_held(scores).collect()}
    assert {(1, "abusive"), (5, "hateful"), (6, "sexual"), (8, "abusive")} <= held and not {d for d, _ in held} & {2, 3, 4, 7}
    span = next(r.spans for r in scores.collect() if r.doc_id == 1)
    assert span and texts[1][span[0][0] : span[0][1]].startswith("Ты")
    assert toxicity.score_documents(docs.limit(0), labelled).collect() == []
    with pytest.raises(ValueError):
        toxicity.train(labelled.limit(0))


def test_toxicity_learns_unlisted_words():
    """Words of no vocabulary class are learned from labelled texts, inflected and disguised too; a name is known in both scripts."""
    heads = ("Бригадир", "Сосед", "Сварщик", "Диспетчер", "Кладовщик", "Электрик")
    learned = [(f"{h} – бздюхля и хрюндель, каких свет не видывал.", "abusive") for h in heads] + [(f"{h} принял щит и муфту после осмотра.", "none") for h in heads] * 3
    learned += [(f"{h} говорит: залмарцы хуже чумы, гнать залмарцев.", "hateful") for h in heads]
    field = toxicity.fit([*learned, *LABELLED * 3])
    assert not any(f.startswith("c=") for w in ("бздюхля", "бздюхлей", "хрюндель", "залмарцы") for f in field.words.features(w)[0])
    texts = ["Редактор – бздюхля и хрюндель.", "Опять бздюхлей и хрюнделем оказался.", "Б з д ю х л я и хрюнд3ль.", "Редактор принял щит."]
    got = toxicity.Scorer(field).documents(texts)
    assert [g[0] >= toxicity.THRESHOLD for g in got] == [True, True, True, False]
    assert toxicity.Scorer(field).documents(["Zalmarians again, zalmars everywhere."])[0][1] >= toxicity.THRESHOLD


def test_toxicity_without_vocabulary():
    """The vocabulary gates nothing: without it the field still finds what the labels hold."""
    field = toxicity.fit(LABELLED * 6, {})
    got = toxicity.Scorer(field).documents([t for t, _ in LABELLED])
    assert [k if k == "none" else "found" if g[toxicity.KINDS.index(k)] >= toxicity.THRESHOLD else "lost" for (_, k), g in zip(LABELLED, got)] == ["found"] * 7 + ["none"] * 3
    assert all(max(g[:3]) < toxicity.THRESHOLD for (_, k), g in zip(LABELLED, got) if k == "none")


def test_toxicity_reads_general_words(small):
    """Sentences of no pattern of the labelled texts, with general words."""
    import pyarrow.parquet as pq

    field = toxicity.fit([(r["text"], r["kind"]) for r in pq.read_table(f"{small}/labelled_texts.parquet").to_pylist()])
    kinds = lambda t: [k for k, v in zip(toxicity.KINDS, toxicity.Scorer(field).documents([t])[0]) if v >= toxicity.THRESHOLD]
    assert "abusive" in kinds("Get lost you muppet, nobody wants a wanker like you here.")
    assert "abusive" in kinds("Ну и мудак же этот ваш сменный мастер.")
    assert kinds("Оперативный персонал обязан записать показания в журнал до конца смены.") == [] and kinds("Thank you all for the quick answer about the feeder.") == []


def test_toxicity_labels_are_spans():
    """Of a labelled text only the sentence that is not like clean ones is tagged, and only from its first telling word to its last."""
    rows = [("Щит осматривают ежедневно. Щит – гадкий бздюх щита.", "abusive"), ("Это бздюх, гадкий человек.", "abusive")] * 2 + [("Щит осматривают ежедневно, а щита не видно.", "none")] * 4
    tags = [list(zip(t, g)) for t, g in toxicity._labelled_sentences(rows, toxicity.Words())]
    assert all(g == 0 for _, g in tags[0]) and tags[1] == [("Щит", 0), ("гадкий", 1), ("бздюх", 1), ("щита", 0)]


def test_toxicity_long_sentences_are_read_whole():
    """A sentence without stops is read in overlapping stretches: bounded memory, nothing lost at a seam."""
    field = toxicity.fit(LABELLED * 6)
    for at in (0, 200, 255, 256, 300, 99_990):
        words = ["щит"] * 100_000
        words[at : at + 3] = ["ты", "идиот", "дурак"]
        text = " ".join(words)
        score = toxicity.Scorer(field).documents([text])[0]
        assert score[0] >= toxicity.THRESHOLD and any("идиот" in text[a:b] for a, b in score[3]), at


def test_toxicity_held_out(spark, small):
    """Trained on one half of the labelled texts, right on the other."""
    labelled = spark.read.parquet(f"{small}/labelled_texts.parquet")
    rest = labelled.where("text_id % 2 = 1")
    scores = toxicity.score_documents(rest.withColumnRenamed("text_id", "doc_id"), labelled.where("text_id % 2 = 0"))
    held = {(r.doc_id, r.kind) for r in toxicity.kinds_held(scores).collect()}
    want = {(r.text_id, r.kind) for r in rest.where("kind <> 'none'").collect()}
    assert len(held & want) >= 0.95 * len(want) and len(held - want) <= 0.05 * len(want)


def test_toxicity_reads_every_labelled_row(spark):
    """What only the last of many labelled rows say is learned."""
    known = [(i, *LABELLED[i % len(LABELLED)]) for i in range(20_000)]
    last = [(20_000 + i, f"{h} – бздюхля и хрюндель.", "abusive") for i in range(100) for h in ("Сосед", "Сварщик", "Автор", "Прораб", "Мастер")]
    field = toxicity.train(spark.createDataFrame(known + last, "text_id BIGINT, text STRING, kind STRING"))
    got = toxicity.Scorer(field).documents(["Редактор – бздюхля и хрюндель.", "Щиты должны проверяться."])
    assert got[0][0] >= toxicity.THRESHOLD > got[1][0]


def test_toxicity_scores_every_sentence():
    """Scores are the marginals of the whole chain, also where no token speaks for a kind; repeated sentences score alike."""
    import numpy as np

    field = toxicity.fit(LABELLED * 6)
    text = "Щиты должны проверяться дежурным."
    e = np.zeros((1, 4, 4))
    for i, w in enumerate(text[:-1].split()):
        own, after, before = field.token(w)
        e[0, i] += own
        e[0, i + 1 : i + 2] += after
        if i:
            e[0, i - 1] += before
    e[0, 0] += field.start
    assert (e[0, :, 1:].max(1) <= e[0, :, 0]).all()
    want = toxicity.chain(e, np.array([4]), field.move)[1][0, :, 1:].max(0)
    got = toxicity.Scorer(field).documents([text, f"{text} {text}", "… — !"])
    assert min(want) > 0 and np.allclose(got[0][:3], want) and got[1] == got[0] and got[2] == (0.0, 0.0, 0.0, [])


def test_toxicity_neutral_mentions_and_kinds(small):
    """Who is mentioned is no case, what is said of them is; a group's insult is hateful, closed-class words of labelled patterns say nothing."""
    import pyarrow.parquet as pq

    field = toxicity.fit([(r["text"], r["kind"]) for r in pq.read_table(f"{small}/labelled_texts.parquet").to_pylist()])
    texts = {"Foreigners and women share one canteen with our crew.": [], "Ask the chief, one of us, or nobody until morning.": [], "Kuntars are thieves by birth and stupid.": ["hateful"], "Вали отсюда, козёл.": ["abusive"]}
    got = toxicity.Scorer(field).documents(list(texts))
    assert [[k for k, v in zip(toxicity.KINDS, g) if v >= toxicity.THRESHOLD] for g in got] == list(texts.values())
    assert field.words.features("nobody")[:2] == field.words.features("одну")[:2] == ([], [])


def test_chain_against_all_paths():
    import numpy as np

    rnd = np.random.default_rng(1)
    length = np.array([1, 3, 5])
    e, move = rnd.normal(size=(3, 5, 4)), rnd.normal(size=(4, 4))
    z, m, moves = toxicity.chain(e, length, move)
    from itertools import product

    brute, brute_moves = np.zeros_like(e), np.zeros((4, 4))
    for i, n in enumerate(length):
        total = np.logaddexp.reduce([sum(e[i, t, y[t]] for t in range(n)) + sum(move[y[t - 1], y[t]] for t in range(1, n)) for y in product(range(4), repeat=int(n))])
        assert abs(total - z[i]) < 1e-9 and np.allclose(m[i, :n].sum(1), 1)
        for y in product(range(4), repeat=int(n)):
            p = np.exp(sum(e[i, t, y[t]] for t in range(n)) + sum(move[y[t - 1], y[t]] for t in range(1, n)) - total)
            brute_moves += np.bincount([4 * a + b for a, b in zip(y, y[1:])], minlength=16).reshape(4, 4) * p
            for t in range(n):
                brute[i, t, y[t]] += p
    assert np.allclose(m, brute) and np.allclose(moves, brute_moves)


def test_words_are_letters_and_digits(spark):
    """The Java class of a word and the Python one are the same (later scripts differ by Unicode version only)."""
    chars = [chr(c) for c in [*range(0x20, 0x800), *range(0x2000, 0x2C00), *range(0xFF00, 0xFFF0)] if chr(c).lower() == chr(c)]
    df = spark.createDataFrame([(c,) for c in chars], "c STRING").select("c", text.word_string(F.col("c")).alias("w"))
    assert not [r.c for r in df.collect() if bool(r.w) != bool(leakage.WORD.findall(r.c))]
