"""Operators on documents against plain versions, with the odd rows that tables may hold."""

import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomline.llm import exact_dedup, langid, mixing, near_dedup, queries, sentencepiece_bpe, sharding, substring_dedup

from . import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, anchor string, kept int, part int"


def rows_of(seed=0):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(30):
        base = [r.choice(words) for _ in range(r.choice([3, 40, 90, 200]))]
        for _ in range(r.choice([1, 1, 2, 4])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 3])):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(r.choice([" ", "  ", "\n"]).join(copy))
    passage = " ".join(r.choice(words) for _ in range(90))
    texts += [" ".join(r.choice(words) for _ in range(20)) + " " + passage + " " + r.choice(words) for _ in range(5)]
    texts += ["", None, " \t\n", "One", "one", "É été", "a b c d", "a b c d", "x " * 5000, "\x00\x0b\x0c\r é", "ab" * 400, "日本語 のテキスト", "😀" * 120]
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[0]), (None, None), (None, "lonely null id text of words"), (rows[5][0], "another text with an id that was there")]


@pytest.fixture(scope="module")
def table(spark):
    rows = rows_of()
    r = random.Random(1)
    full = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", "é", None]), None, "x", "y", 1, 2) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_exact(table, empty):
    assert collected(exact_dedup.exact_groups(table)) == plain.exact(pairs(table))
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_group_over_many_partitions(spark):
    rows = [(k, "same  text" if k % 3 else f"own {k % 50}") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert collected(exact_dedup.exact_groups(df.repartition(13))) == plain.exact(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_near(table, empty):
    got = collected(near_dedup.near_groups(table))
    want = plain.near(pairs(table))
    named = lambda rows: [r for r in rows if r[0] is not None]
    assert named(got) == named(want)
    assert [r[:3] for r in got if r[0] is None] == [r[:3] for r in want if r[0] is None]
    assert near_dedup.near_groups(empty).count() == 0


def test_near_copies_are_compared(spark, monkeypatch):
    """Copies in many spacings, dealt to several groups; where keys can't tell texts apart, the work ends instead of linking them."""
    monkeypatch.setattr(near_dedup, "HUB_NODES", 7)
    words = [f"w{k}" for k in range(30)]
    rows = [(k, (" " * (k % 5 + 1)).join(words).upper() + "\t" * (k % 3)) for k in range(60)] + [(None, " ".join(words))] * 20 + [(k, f"other text number {k} " * 4) for k in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(near_dedup.near_groups(df)) == plain.near(rows)
    batch = pa.RecordBatch.from_pydict({"node": [b"a", b"a", b"b"], "salt": [0, 0, 0], "salts": [1, 1, 1], "text": ["x  Y", "X y", "z"]})
    assert [x for b in near_dedup._leaders(iter([batch])) for x in b.column("text").to_pylist()] == ["x  Y", "z"]
    wrong = pa.RecordBatch.from_pydict({"node": [b"a", b"a"], "salt": [0, 0], "salts": [1, 1], "text": ["x y", "x z"]})
    with pytest.raises(RuntimeError):
        list(near_dedup._leaders(iter([wrong])))


def test_near_blocks_settle_what_hubs_leave(spark, monkeypatch):
    """Chains of near copies, where the ends are no link of any hub, with blocks of a few rows."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    r = random.Random(3)
    rows, words = [], [f"v{k}" for k in range(5000)]
    for _ in range(4):
        text = [r.choice(words) for _ in range(150)]
        for _ in range(12):
            rows.append((len(rows), " ".join(text)))
            for _ in range(3):
                text[r.randrange(150)] = r.choice(words)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(near_dedup.near_groups(df)) == plain.near(rows)


def test_near_copies_of_a_common_passage(spark, monkeypatch):
    """A bucket of thousands of nodes in two components: those of the smaller one are compared with the others, not the others with each other."""
    monkeypatch.setattr(near_dedup, "HUB_NODES", 300)
    r = random.Random(13)
    passage = [f"p{k}" for k in range(120)]
    rows = []
    for k in range(2400):
        text = list(passage)
        text[r.randrange(120)] = f"own{k}"
        rows.append((k, " ".join(text)))
    for k in range(3):
        rows.append((5000 + k, " ".join(passage[:60] + [f"tail{j}" for j in range(60)] + [f"x{k}"])))
    got = {x.doc_id: x.component_id for x in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[k] for k in range(2400)} == {0} and {got[5000 + k] for k in range(3)} == {5000}


def test_sets_are_counted_by_numbers_not_hashes():
    r = random.Random(14)
    hasher = near_dedup.Hasher()
    for n, kinds in ((0, 1), (1, 1), (4, 2), (5, 3), (3000, 4), (3000, 2000), (60_000, 50_000), (200_000, 9)):
        text = " ".join(f"W{r.randrange(kinds)}" for _ in range(n))
        assert len(hasher(near_dedup.words_of(text))) == len(plain.shingles(text)), (n, kinds)


def test_signatures_estimate_similarity():
    import numpy as np

    r = np.random.default_rng(0)
    pool = r.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = pool[:3500], pool[500:]
    sig = near_dedup.signatures([a, b], 1024)
    assert abs((sig[0] == sig[1]).mean() - 3000 / 4000) < 0.05


def test_shards(table, empty):
    got = sharding.shard_rows(table, 16).collect()
    text = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs(table)), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == text
    assert all((r.law, r.shard, r.grown_shard) == ("key", plain.jump(r.doc_id, 16), plain.jump(r.doc_id, 17)) for r in got)
    for shard in range(16):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_rows(empty).count() == 0


def test_jump_hash_of_odd_keys(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901, None]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 16, 1000):
        assert [r.s for r in df.select(sharding.jump_shard(F.col("k"), shards).alias("s")).collect()] == [plain.jump(k, shards) for k in keys]


def test_repeats(table, empty):
    assert collected(substring_dedup.remove_repeats(table)) == plain.repeats(pairs(table))
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_repeats_of_anchors_too_common_for_a_shard(table, monkeypatch):
    monkeypatch.setattr(substring_dedup, "ANCHOR_SEGMENTS", 1)
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 3000)
    assert collected(substring_dedup.remove_repeats(table)) == plain.repeats(pairs(table))


def test_repeats_in_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 1000)
    r = random.Random(5)
    part = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = part(900)
    rows = [(1, part(2500) + shared + part(700)), (2, part(100) + shared + part(3000) + shared[:300]), (3, part(1500)), (4, "z" * 1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(substring_dedup.remove_repeats(df)) == plain.repeats(rows)


def test_repeats_of_many_rows_without_an_id(spark):
    """Rows that share an id, or have none, are never taken for one another, however many they are."""
    part = lambda k: F.sha2(F.concat(F.col("id").cast("string"), F.lit(f":{k}")), 256)
    rows = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("doc_id"), F.concat(*(part(k) for k in range(4))).alias("text"))
    df = rows.unionByName(rows.limit(1))
    got = substring_dedup.remove_repeats(df)
    assert got.count() == 200_001 and [r.n_removed for r in got.where("n_removed > 0").collect()] == [256, 256]


def test_mix(table, empty):
    got = mixing.mix(table).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(table.repartition(3)).collect()), key=repr)
    sources = {}
    for r in got:
        assert r.size * r.copies == r.taken <= 3 * r.size
        s = sources.setdefault((r.source_size, r.target), [0, 0, 0])
        s[0] += r.size
        s[1] += r.taken
        s[2] = max(s[2], r.size)
    total = sum(s[0] for s in sources.values())
    assert abs(sum(t for _, t in sources) - total) < 1e-6 * total
    for (size, target), (whole, taken, largest) in sources.items():
        assert whole == size and target <= 3 * size + 1e-9 and abs(taken - target) <= 3 * largest
    assert mixing.mix(empty).count() == 0


def test_mix_targets_reshare_what_caps_leave(spark):
    sizes = [("a", 100), ("b", 10), ("c", 1000), (None, 5)]
    df = spark.createDataFrame([("" if s is None else "=" + s, s, n) for s, n in sizes], "skey string, source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got["b"] == 30 and got[None] == 15
    assert abs(got["a"] - (1115 - 45) / 4) < 1e-9 and abs(got["c"] - 3 * (1115 - 45) / 4) < 1e-9


def test_inclusion_follows_the_odds(spark):
    """Documents are drawn as often as their size's chance says, over many seeds; rows without an id draw their own."""
    from collections import defaultdict

    r = random.Random(11)
    rows = [(None if k % 5 == 0 else k, " ".join(f"w{k}x{j}" for j in range(r.choice([1, 2, 5, 14, 40, 120]))), "ab"[k % 2]) for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seeds, sums = 24, defaultdict(lambda: [0, 0])
    for k in range(seeds):
        for x in mixing.mix(df, seed=f"s{k}").collect():
            got = sums[x.source_size, x.size]
            got[0] += x.copies
            got[1] += 1
    for source in {s for s, _ in sums}:
        mean = {n: c / m for (s, n), (c, m) in sums.items() if s == source}
        digits = {n: n.bit_length() for n in mean}
        target = sum(n * c for (s, n), (c, _) in sums.items() if s == source) / seeds
        words = {n: n * m / seeds for (s, n), (_, m) in sums.items() if s == source}
        low, high = 0.0, 3.0
        for _ in range(60):
            c = (low + high) / 2
            low, high = (c, high) if sum(w * min(3, c * digits[n]) for n, w in words.items()) < target else (low, c)
        for n, got in mean.items():
            assert abs(got - min(3, low * digits[n])) < 0.12, (source, n, got, low * digits[n])
    one, two = ([x.copies for x in mixing.mix(df.where("doc_id is null and source = 'a'"), seed=s).collect()] for s in ("p", "q"))
    assert sorted(one) != [] and one != two


def test_salted_join_gives_the_same_mix(table, monkeypatch):
    want = collected(mixing.mix(table))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert collected(mixing.mix(table)) == want


def test_sentencepiece_is_the_library(table, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    import hashlib
    import struct

    path = queries.tokenizer_path()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    for doc_id, text in pairs(table):
        ids = lib.encode(text or "", add_bos=True, add_eos=True)
        model = sentencepiece_bpe.model_at(path, hashlib.sha256(open(path, "rb").read()).hexdigest())
        assert list(model.encode(text or "")) == ids and model.decode(ids) == lib.decode(ids), doc_id
    want = []
    for doc_id, text in pairs(table):
        ids = lib.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert collected(sentencepiece_bpe.encode_rows(table, path)) == sorted(want, key=repr)
    assert sentencepiece_bpe.encode_rows(empty, path).count() == 0
    r = random.Random(2)
    for _ in range(2000):
        text = "".join(r.choice("ehtisaonr  \n.▁é日😀ä\t") for _ in range(r.randint(0, 70)))
        ids = lib.encode(text, add_bos=True, add_eos=True)
        assert list(model.encode(text)) == ids and model.decode(ids) == lib.decode(ids), text


def language_rows():
    r = random.Random(4)
    parts = {"en": "the of and th ing er on at en re".split(), "de": "der die und ung sch ein ver ge zu ich".split(), "ru": "пр ст но ко ра ть ов на ли ми".split()}
    word = lambda lang: "".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3)))
    rows = [(k, " ".join(word(lang) for _ in range(r.randint(5, 60))), lang) for k in range(400) for lang in [r.choice(list(parts))]]
    return rows, word


def test_language_is_found_on_held_out_rows(spark, empty):
    rows, word = language_rows()
    odd = [(1000, None, "en"), (1001, "123 ... ²", "de"), (1002, "", None), (None, rows[0][1], None), (1003, "日本", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = langid.fit(df)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert model.langs == ["de", "en", "ru"] and len(got) == len(rows) + len(odd)
    held = [(lang, got[i].lang_pred) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 80 and sum(a == b for a, b in held) > 0.97 * len(held)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003].lang_pred in model.langs and got[None].lang_pred == got[0].lang_pred
    nothing = langid.fit(empty)
    assert nothing.langs == [] and {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_spans_of_mixed_text(spark):
    rows, word = language_rows()
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    text = " ".join([word("en") for _ in range(30)] + [word("ru") for _ in range(30)] + [word("de") for _ in range(30)])
    assert [s[2] for s in langid.spans(text, langid.Words(model))] == ["en", "ru", "de"]


def test_words_with_marks_and_scripts_that_nobody_learned(spark):
    """Composed and decomposed text are the same words, marks belong to them, and no script means no certainty."""
    import unicodedata

    assert langid.words_of("re\u0301sume\u0301 de\u0301ja\u0300, 12 नमस्ते हिन्दी") == ["résumé", "déjà", "नमस्ते", "हिन्दी"]
    assert langid.words_of("\u0301 ² Ⅷ _") == []
    for text in (x or "" for _, x in rows_of(15)):
        assert langid.words_of(text) == langid._WORD.findall(unicodedata.normalize("NFC", text))
    low = "".join(map(chr, range(0x300))) + "\u2019\u201c"
    assert langid.words_of(low) == langid._WORD.findall(low) and langid.words_of("a\u200db c") == ["a\u200db", "c"]
    rows, word = language_rows()
    rows += [(2000 + k, " ".join(["हिन्दी", "भाषा", "नमस्ते", "यह", "और", "किताब"][(k + j) % 6] for j in range(12)), "hi") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    words = langid.Words(model)
    assert langid.label_texts(["यह किताब और भाषा"], words) == [("hi", 1.0)]
    text = "ünd schön ver der é " * 5
    assert langid.label_texts([text], words) == langid.label_texts([unicodedata.normalize("NFD", text)], words)
    latin = langid.fit(docs.where("lang in ('en', 'de')"))
    odd = ["これは日本語です", "Это русский текст", "\u0301\u0302", "the of and 日本", "the " * 300_000, "t"]
    got = langid.label_texts(odd, langid.Words(latin))
    assert got[:3] == [("de", 0.0), ("de", 0.0), ("und", 0.0)] and got[3] == ("en", 8 / 10) and got[4] == ("en", 1.0) and got[5][0] in latin.langs
    kept = langid.keep_certain(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), latin)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]


def test_fit_counts_as_a_plain_version(spark):
    """Trigrams, scripts and scores of a small fit, counted plainly over the rows that are not held out."""
    from collections import Counter

    import numpy as np

    rows = [(k, t, lang) for k, (t, lang) in enumerate([("abc abd", "x"), ("abd xyz", "y"), ("ab Zé", "x"), ("яб", "y"), ("q r", "y")] * 6)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    used = [(t, lang) for k, t, lang in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    grams = Counter((lang, m[i : i + 3]) for t, lang in used for w in t.lower().split() for m in [f"<{w}>"] for i in range(len(m) - 2))
    assert set(model.gram) == {g for _, g in grams}
    count = np.array([[0.5 + (grams[lang, g] if g else 0) for lang in ("x", "y")] for g in [None, *model.gram]])
    assert np.allclose(model.score, langid.GRAM_WEIGHT * np.log(count / count.sum(axis=0)), atol=1e-5)
    assert {s: list(a) for s, a in model.allowed.items()} == {"Latin": [True, True], "Cyrillic": [False, True]}


def test_best_path_is_the_best():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(50):
        lengths = r.integers(1, 7, 5)
        scores = r.normal(size=(lengths.sum(), 3)).astype(np.float32) * 3
        labels = langid.best_path(scores, lengths, 2.0)
        for start, n in zip(np.cumsum(lengths) - lengths, lengths, strict=True):
            value = lambda p, s=start: sum(scores[s + i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p))
            best = max(itertools.product(range(3), repeat=int(n)), key=value)
            assert abs(value(best) - value(tuple(labels[start : start + n]))) < 1e-4


def test_whole_rows_come_through(table):
    """Rows with null and repeated ids, and columns whose names the operators use themselves."""
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    whole = rows(table)
    first = exact_dedup.keep_first(table)
    assert first.columns == table.columns and set(rows(first)) <= set(whole)
    assert sorted(plain.normal(r[1]) for r in rows(first)) == sorted({plain.normal(r[1]) for r in whole})
    one = near_dedup.keep_one(first)
    least = {r[2] for r in plain.near(pairs(first)) if r[1] and r[2] is not None}
    assert one.columns == table.columns and set(rows(one)) <= set(rows(first))
    assert {r[0] for r in rows(one) if r[0] is not None and plain.shingles(r[1])} == least
    assert {r[1] for r in rows(one)} >= {r[1] for r in rows(first) if not plain.shingles(r[1])}
    mixed = mixing.repeat_rows(table)
    assert mixed.columns == table.columns and set(rows(mixed)) <= set(whole)
    assert sum(len((r[1] or "").split()) for r in rows(mixed)) == sum(r.taken for r in mixing.mix(table).collect())
