"""Each corpus operator against a brute-force version, and on its edge cases."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.llm import cotrain, decontam, hostrules, jaccard, langid, packing, queries, secretscan, sharding, substring, textscan, urlrep

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, value int"


def docs_of(spark, texts, sources=None):
    """Documents with extra columns whose names the operators use inside."""
    rows = [(i, t, "en", sources[i] if sources else "s", len(t or ""), "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, and odd texts."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)] + ["Été", "straße", "naïve", "A", "a"]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    passage, base = make(60), make(120)
    texts = [None, "", " \n\t ", "one", "two words", "a b c", "a b c", "x\x0by\x0cz", "no break space", "\U0001f600 emoji text \U0001f600"]
    texts += [" ".join(make(rng.randint(5, 200))) for _ in range(25)]
    texts += [" ".join(make(20) + passage + make(20)) for _ in range(6)]
    for k in range(12):
        copy = list(base)
        for _ in range(k % 5):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += [texts[20]] * 4 + ["\n".join(["same line again"] * 6), " ".join(["rep"] * 90), " ".join(make(6000))]
    return texts


def plain_words(text):
    return (text or "").encode().split()


# 1. Packing


@pytest.fixture(scope="module")
def files():
    return queries.tokenizer_files()


def test_encoder_equals_the_tokenizer_file(files, corpus):
    odd = ["<|endoftext|>", "a<|endoftext|>b", "tabs\t\t and   spaces \n\n x", "9" * 300, "日本語 text", "'s 'T don't"]
    encode, exact = packing.encoder(**files), packing.exact_encoder(files["json_path"])
    for text in [*odd, *[t for t in corpus if t]]:
        assert encode(text) == exact.encode(text, add_special_tokens=False).ids


def test_packing_is_a_gapless_cover(spark, corpus, files):
    rows = packing.pack(docs_of(spark, corpus), files, capacity=64, group_pieces=40).collect()
    exact = packing.exact_encoder(files["json_path"])
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(corpus)))
    for i, text in enumerate(corpus):
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert k == 0 or r.length == 64 or len(ids) <= 64
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    bound = packing.lower_bound(np.array([r.length for r in rows]), 64)
    assert bound <= len(by_seq) <= bound + 3 and {r.bound for r in rows} == {bound}


def test_packing_of_very_long_texts(spark, files):
    texts = [" " * 5_000_000 + "x", "\n" * 700_000 + " a", "abcdefgh" * 125_000, "7" * 1_000_000, None, "same", "same"]
    rows = packing.pack(docs_of(spark, texts), files).collect()
    exact = packing.exact_encoder(files["json_path"])
    total = collections.Counter()
    for r in rows:
        total[r.doc_id] += r.length
    assert total == {i: len(exact.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_packing_of_nothing(spark, files):
    assert packing.pack(docs_of(spark, ["x"]).limit(0), files).count() == 0


def test_lower_bound_is_a_bound():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 65, 40)
        assert packing.lower_bound(lengths, 64) <= len(packing.best_fit_decreasing(lengths, 64)[2])
    assert packing.lower_bound(np.array([40] * 10), 64) == 10  # the plain sum would say 7


# 2. Sharding


def test_shards_are_even_and_numbered(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    placed, stored = sharding.shard(documents, 7, 512)
    rows = placed.collect()
    texts = dict(documents.select("doc_id", "text").collect())
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    load, places = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert len(load) == 7 and max(load.values()) - min(load.values()) < 0.02 * max(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert stored.versions() == [1, 2]


def test_a_stored_map_is_loaded_and_edited(spark, tmp_path):
    make = lambda n, of: spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.pmod(F.xxhash64("id", F.lit(of)), F.lit(200)).cast("int")).alias("text"))
    first = make(4000, 1)
    path = str(tmp_path / "map")
    placed, slot_map = sharding.shard(first, 5, 512, path)
    before = {r.doc_id: r.shard for r in placed.collect()}
    again, _ = sharding.shard(first, 5, 512, path)
    assert {r.doc_id: r.shard for r in again.collect()} == before and slot_map.versions() == [1, 2]  # nothing to edit
    more, _ = sharding.shard(first.unionAll(make(4200, 2).filter("doc_id >= 4000")), 5, 512, path)
    rows = more.collect()
    assert slot_map.versions() == [1, 2, 3]
    assert np.mean([r.shard != before[r.doc_id] for r in rows if r.doc_id in before]) < 0.1
    grown, _ = sharding.shard(first, 6, 512, path)
    moved = [(before[r.doc_id], r.shard) for r in grown.collect() if r.shard != before[r.doc_id]]
    assert slot_map.versions() == [1, 2, 3, 4] and np.mean([to == 5 for _, to in moved]) > 0.6
    held = {v: dict(slot_map.table(v).select("slot", "shard").collect()) for v in slot_map.versions()}
    assert all(len(h) == 512 for h in held.values()) and sum(held[2][k] != held[3][k] for k in range(512)) < 60
    places = collections.defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    with pytest.raises(ValueError):
        sharding.shard(first, 3, 512, path)


def test_shards_of_a_very_long_text(spark):
    placed, _ = sharding.shard(docs_of(spark, ["é" * 3_000_000, "a", None]), 2, 16)
    assert {r.doc_id: r.size for r in placed.collect()} == {0: 6_000_008, 1: 9, 2: 8}


def test_grown_maps_only_fill_the_new_shard():
    sizes = np.random.default_rng(2).integers(1, 1000, 512)
    held = sharding.rebalance(sharding.initial_map(512, 6), sizes, 6)
    grown = sharding.grow(held, sizes, 6)
    assert set(grown[grown != held]) == {6}
    load = np.bincount(grown, sizes, 7)
    assert load[6] > 0.9 * sizes.sum() / 7


def test_shards_with_null_ids_and_rows_twice(spark):
    rows = [(None, "a"), (None, "a"), (1, None), (1, None), (2, "")]
    placed, _ = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 3, 16)
    assert placed.count() == 5
    empty, _ = sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 3, 16)
    assert empty.count() == 0


# 3. Decontamination


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated_by_force(texts, items, window):
    phrases = collections.defaultdict(set)
    for item, text in items:
        words = bench_words(text)
        n = min(window, len(words))
        for k in range(len(words) - n + 1) if n else ():
            phrases[tuple(words[k : k + n])].add(str(item))
    out = {}
    for i, text in enumerate(texts):
        words, hit, found = bench_words(text), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(words) - n + 1):
                if (own := phrases.get(tuple(words[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= own
        out[i] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_words", [500_000, 40])
def test_decontamination(spark, corpus, monkeypatch, block_words):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block_words)
    long_text = corpus[-1].split()
    items = [(1, " ".join(long_text[30:60])), (2, " ".join(long_text[50:75])), (10, "TWO words"), (3, None), (4, "..."), (5, corpus[20]), (5, corpus[20]), (6, "Été")]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id int, text string, terms string")
    rows = decontam.digest(decontam.contamination(docs_of(spark, corpus), benchmark)).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    assert got == contaminated_by_force(corpus, items, 10)


def test_proximity_and_empty_tables(spark):
    docs = docs_of(spark, ["zeta x alpha y beta", "alpha " + "pad " * 40 + "beta zeta", None])
    items = spark.createDataFrame([(1, "alpha beta zeta")], "item_id int, text string")
    near = {r.doc_id: r.near for r in decontam.contamination(docs, items, reach=8).collect()}
    assert near == {0: ["1"], 1: [], 2: []}
    assert decontam.digest(decontam.contamination(docs, items.limit(0))).filter("n_hit > 0").count() == 0
    assert decontam.digest(decontam.contamination(docs.limit(0), items)).count() == 0


# 4. Jaccard join


def linked_by_force(texts, size=4, percent=85):
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("leaf, most, levels", [(32, jaccard.REGION_BYTES, 6), (2, 3000, 6), (1, 3000, 0), (1, 1000, 2)])
def test_jaccard(spark, corpus, monkeypatch, leaf, most, levels):
    monkeypatch.setattr(jaccard, "LEVELS", levels)
    rows = jaccard.linked(docs_of(spark, corpus), leaf=leaf, most=most).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == linked_by_force(corpus)


def test_jaccard_of_a_large_group_around_one_document(spark):
    """Copies that are linked with the original alone, split by Spark; beside it a chain, linked step by step."""
    rng = random.Random(12)
    make = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    base, texts = make(60), []
    for k in range(20_000):
        copy = list(base)
        copy[5 + k % 50] = f"edit{k}"
        texts.append(copy)
    texts.append(base)
    chain = make(400)
    for k in range(30):
        texts.append(chain[10 * k : 10 * k + 110])
    texts = [" ".join(t) for t in texts]
    rows = {r.doc_id: r.component_id for r in jaccard.linked(docs_of(spark, texts), most=300_000).collect()}
    assert {rows[k] for k in range(20_001)} == {0}
    assert {k: rows[k] - 20_001 for k in range(20_001, 20_031)} == {k + 20_001: c for k, (_, c) in linked_by_force(texts[20_001:]).items()}


def test_jaccard_region_recursion():
    rng = np.random.default_rng(3)
    blobs, plain = [], []
    for c in range(12):
        base = rng.integers(0, 1 << 63, 60)
        for _ in range(30):
            own = base.copy()
            own[rng.integers(0, 60, rng.integers(0, 8))] = rng.integers(0, 1 << 63)
            own = np.unique(own).astype(np.uint64)
            plain.append(set((own >> np.uint64(16)).tolist()))
            blobs.append(own.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes())
    region = jaccard.Region(jaccard.Sets(np.arange(len(blobs)), blobs), 85)
    region.join(np.arange(len(blobs)))
    root = list(range(len(plain)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(plain)):
        for b in range(a):
            common = len(plain[a] & plain[b])
            if 100 * common >= 85 * (len(plain[a]) + len(plain[b]) - common):
                root[find(a)] = find(b)
    same = lambda f: [[f(a) == f(b) for b in range(0, len(plain), 7)] for a in range(len(plain))]
    assert same(find) == same(region.forest.find)


def near_copies(n, most_edits, seed=21):
    """Copies of one text with ever more edits, so that many are near all others and linked with none."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(base)]
    for k in range(n):
        copy = list(base)
        for at in rng.sample(range(150), 1 + k % most_edits):
            copy[at] = rng.choice(["some", "few", "words", f"edit{rng.randrange(40)}", f"own{k}"])
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("columns", [jaccard.COLUMNS, 60])
def test_jaccard_of_near_copies_that_pivots_do_not_separate(spark, monkeypatch, columns):
    """Members of a large region are not copied to all pivots, level after level: their number stays within that of the region."""
    texts, rows = near_copies(300, 12), collections.Counter()
    monkeypatch.setattr(jaccard, "COLUMNS", columns)
    monkeypatch.setattr(jaccard, "LEVELS", 3)
    table = jaccard.Workspace.table

    def counted(self, df, name):
        out = table(self, df, name)
        rows[name] = out.count() if name.startswith("members") else 0
        return out

    monkeypatch.setattr(jaccard.Workspace, "table", counted)
    found = jaccard.linked(docs_of(spark, texts), most=30_000).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == linked_by_force(texts)
    assert all(rows[f"members{k}"] <= jaccard.MOST_COPIES * rows["members0"] for k in range(1, 4)), rows


@pytest.mark.parametrize("columns, dense", [(2048, 1 << 23), (20, 1 << 23), (1, 1)])
def test_jaccard_bounds_of_overlaps(monkeypatch, columns, dense):
    """With any number of columns, what the bounds leave has all links of members that are not of one component."""
    monkeypatch.setattr(jaccard, "COLUMNS", columns)
    monkeypatch.setattr(jaccard, "DENSE", dense)
    monkeypatch.setattr(jaccard, "AT_ONCE", 1000)
    texts = near_copies(200, 14) + near_copies(60, 5, seed=22)
    sets = [s for part in textscan.slices(pa.array(texts, pa.large_string()), textscan.unspaced(lower=True)) for s in jaccard.shingle_sets(part, 4)]
    blobs = [s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for s in sets]
    region = jaccard.Region(jaccard.Sets(np.arange(len(blobs)), blobs), 85)
    compared = []
    monkeypatch.setattr(jaccard.Region, "compare", lambda self, x, others, level, f=jaccard.Region.compare: compared.append(len(others)) or f(self, x, others, level))
    region.outright(np.arange(len(blobs)))
    assert [region.forest.find(k) for k in range(len(blobs))] == [c for _, c in linked_by_force(texts).values()]
    assert columns < 2048 or sum(compared) < len(texts) ** 2 / 20


def test_jaccard_rows_twice_null_ids_and_nothing(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (5, None), (9, "q r s t u")]
    out = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in out) == [(-1, 3), (3, 3), (5, 5), (7, 3), (7, 3), (9, 9)]
    assert jaccard.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 5. Substrings


def removed_by_force(texts, window):
    counts, words = collections.Counter(), [plain_words(t) for t in texts]
    for own in words:
        counts.update(tuple(own[k : k + window]) for k in range(len(own) - window + 1))
    out = {}
    for i, own in enumerate(words):
        gone = set()
        for k in range(len(own) - window + 1):
            if counts[tuple(own[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(own) if k not in gone)
        out[i] = (len(own), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("window, buckets", [(35, None), (8, 3), (5, 1)])
def test_substrings(spark, corpus, window, buckets):
    rows = substring.deduplicated(docs_of(spark, corpus), window, buckets).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == removed_by_force(corpus, window)


def test_a_common_passage_makes_no_large_bucket(spark):
    """In a third of all documents: a bucket gets its windows once a slice, and no request is much larger than the others."""
    rng = random.Random(7)
    make = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    passage, twice = make(40), make(50)
    texts = [" ".join(make(60) + (passage if k % 3 == 0 else twice if k in (1, 2) else []) + make(60)) for k in range(1500)]
    docs = docs_of(spark, texts)
    rows = substring.deduplicated(docs, slices=6).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == removed_by_force(texts, 35)
    assert {tuple(r.spans) for r in rows} == {(60, 100), (60, 110), ()}
    _, replies, slices = substring.repeated(docs, 35, 5, 6)
    windows = collections.Counter()
    for r in replies.collect():
        windows[r.slice] += len(r.hash) // 8
    assert slices == 6 and all(n <= 6 + 16 for n in windows.values())  # those of either passage, however many documents have it


def test_substrings_rows_twice_and_nothing(spark):
    text = " ".join(f"v{k}" for k in range(40))
    out = substring.deduplicated(spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in out) == [0, 40, 40]
    assert substring.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 6. Quality classifier


def test_cotraining_finds_bad_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.filter("doc_id % 4 = 0")
    model = cotrain.fit(docs, labels.filter("doc_id % 4 <> 0"))
    rows = cotrain.scores(docs, model).join(held, "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    junk = [r.kept for r in rows if r.quality == 0]
    toxic = [r.kept for r in rows if r.toxic == 1]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.05 and np.mean(toxic) < 0.1
    kept = cotrain.kept(docs, model)
    assert kept.columns == docs.columns and kept.count() == cotrain.scores(docs, model).filter("kept").count()


def test_cotraining_without_labels_keeps_all(spark, corpus):
    docs = docs_of(spark, corpus)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert cotrain.fit(docs, none) is None
    assert cotrain.scores(docs, None).filter("kept").count() == len(corpus)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "xx", "yy", -3)], "doc_id long, text string, lang string, source string, n_chars long")
    model = cotrain.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert cotrain.scores(odd, model).count() == 2 and cotrain.scores(odd.limit(0), model).count() == 0


def test_samples_hold_each_text_once(spark):
    rng = random.Random(9)
    text = lambda k: " ".join(f"{'bad' if k % 3 == 0 else 'ok'}{rng.randrange(40)}" for _ in range(20))
    rows = [(k, text(k), ("en", "fr")[k % 2], "s", 100, "x", 1) for k in range(240)]
    rows += [(1000 + k, rows[5][1], rows[5][2], "s", 100, "x", 1) for k in range(2000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in [*range(120), *range(1000, 3000)]], "doc_id long, quality int, toxic int")
    read = lambda df: sorted((r.asDict() for r in df.collect()), key=lambda r: r["h"])
    known, few = read(cotrain.sample(docs, labels, 10**6)), read(cotrain.sample(docs, labels, 50))
    of_text = {t: k for k, t, *_ in rows[:240]}
    assert sorted(of_text[r["text"]] for r in known) == list(range(120))
    assert all(r["good"] == (of_text[r["text"]] % 3 > 0) for r in known if of_text[r["text"]] != 5) and not [r for r in known if of_text[r["text"]] == 5][0]["good"]
    assert few == known[:50]
    bytes_of = np.cumsum([len(r["text"]) for r in known])
    assert read(cotrain.sample(docs, labels, 10**6, 2000)) == known[: int((bytes_of <= 2000).sum())]
    assert {r.text: r.lang for r in langid.sample(docs, 10**6).collect()} == {t: x for _, t, x, *_ in rows[:240]}


def test_pseudo_labels_come_from_all_documents(spark):
    """Counted plainly: every feature of one view, in the documents that the other is sure of."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionAll(docs.limit(3)).repartition(5)
    model = cotrain.fit(docs, labels, rounds=0)
    found = cotrain.handed(docs, model)
    columns = [c for c in cotrain.inputs(docs).columns]
    sums = [collections.defaultdict(lambda: [0, 0]) for _ in range(2)]
    for r in cotrain.inputs(docs).collect():
        batch = pa.RecordBatch.from_pylist([r.asDict()], schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string()), ("lang", pa.string()), ("n_chars", pa.int64())]))
        [views] = cotrain._rows(model, {c: k for k, c in enumerate(columns)}, batch)
        sure = [cotrain.sigmoid(z)[0] for z in model.views(*views)]
        for own, p, count in zip(views, reversed(sure), sums):
            for f in own.ids if p >= cotrain.SURE or p <= 1 - cotrain.SURE else ():
                count[int(f)][int(p > 0.5)] += 1
    for odds, count in zip(found, sums):
        bad, good = np.zeros(len(odds)), np.zeros(len(odds))
        for f, pair in count.items():
            bad[f], good[f] = pair
        assert np.allclose(odds, cotrain.log_odds(good, bad))
    assert any(odds.any() for odds in found)
    again = cotrain.fit(docs.repartition(2), labels)
    same = cotrain.fit(docs.repartition(7), labels)
    assert all(np.array_equal(a.odds, b.odds) and np.array_equal(a.learner.sparse, b.learner.sparse) for a, b in ((again.text, same.text), (again.meta, same.meta)))


# 7. Secrets


def spans_by_force(text):
    text = text or ""
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


SECRETS = [
    "password = 'hunter22' and é token:abc123def", "TOKEN=short", "secret=token:abcdefg", "api_key: \U0001f600 apikey=ABCDEF.gh",
    "AKIA" + "A1" * 8, "AKIA" + "A1" * 7, "xAKIAAKIA" + "B2" * 9, "f" * 24, "g" + "0a" * 20 + "z deadbeef", None, "",
    "password=" + "0123456789abcdef" * 3 + " tail", "passwd\"  :  \"abcdef\" passwd='abcdef'", "token==abcdefgh",
]


def test_base_spans(spark):
    rows = secretscan.digest(secretscan.with_secrets(docs_of(spark, SECRETS), None)).collect()
    for r in rows:
        spans = spans_by_force(SECRETS[r.doc_id])
        text = ",".join(f"{secretscan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.spans == text and r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))


def test_models_tell_random_strings_from_identifiers(spark):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    random_one = lambda: "".join(rng.choice(letters) for _ in range(24))
    parts = ["get", "user", "name", "list", "item", "count", "total", "value", "index", "table"]
    ordinary = lambda: "_".join(rng.choice(parts) for _ in range(5))
    samples = [(random_one(), True) for _ in range(2000)] + [(ordinary(), False) for _ in range(2000)]
    table = secretscan.train(spark.createDataFrame(samples, "token string, is_random boolean"))
    texts = [f"see {random_one()} here" for _ in range(40)] + [f"see {ordinary()} here" for _ in range(40)]
    rows = secretscan.digest(secretscan.with_secrets(docs_of(spark, texts), table)).collect()
    found = {r.doc_id: "markov" in r.spans for r in rows}
    assert sum(found[i] for i in range(40)) >= 38 and not any(found[i] for i in range(40, 80))
    assert secretscan.train(spark.createDataFrame([], "token string, is_random boolean")) is None


def test_models_count_rare_random_strings(spark):
    docs = spark.range(20_100).select(F.concat(F.lit("plain text "), F.col("id")).alias("text"))
    rare = spark.range(40).select(F.concat(F.lit("found "), F.md5(F.col("id").cast("string"))).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(2)) == 1).limit(3)
    samples = secretscan.labelled_samples(docs.unionAll(rare))
    assert samples.filter("is_random").count() == 3
    assert secretscan.train(samples) is not None


def test_redaction(spark):
    docs = docs_of(spark, SECRETS).withColumns({c: F.lit(c) for c in ("base", "spans", "tokens", "raw", "row", "hex")})
    rows = {r.doc_id: r for r in secretscan.redacted(docs, None).collect()}
    assert all((r.base, r.spans, r.row, r.hex, r.lang) == ("base", "spans", "row", "hex", "en") for r in rows.values())
    for i, text in enumerate(SECRETS):
        out, at = "", 0
        for a, _, b in spans_by_force(text):
            if b > at:
                out += (text or "")[at : max(a, at)] + "[SECRET]"
                at = b
        assert rows[i].text == out + (text or "")[at:] and rows[i].n_chars == len(rows[i].text)
    assert secretscan.redacted(docs, None).columns == docs.columns


def markov_by_force(text, table):
    base = spans_by_force(text)
    ratios = list(map(float, table.split(",")))
    place = {c: k for k, c in enumerate(secretscan.ALPHABET)}
    out = []
    for m in re.finditer(secretscan.TOKEN, text or ""):
        score = sum(ratios[place[a] * len(place) + place[b]] for a, b in zip(m[0], m[0][1:]))
        if score > secretscan.MARGIN and not any(a < m.end() and m.start() < b for a, _, b in base):
            out.append((m.start(), 3, m.end()))
    return out


def test_all_spans_by_force(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_="
    one = lambda n: "".join(rng.choice(letters) for _ in range(n))
    word = lambda: "_".join(rng.choice(["user", "name", "list", "count", "total"]) for _ in range(5))
    bits = [lambda: one(rng.randint(10, 40)), word, lambda: f"token={one(8)}", lambda: "é " + "0a1b" * 7, lambda: "plain words here", lambda: "AKIA" + "Z9" * 9 + one(5), lambda: one(9) + "deadbeef" * 4 + one(9)]
    texts = [*SECRETS, *[rng.choice([" ", "", "\n"]).join(rng.choice(bits)() for _ in range(rng.choice([3, 60, 300]))) for _ in range(30)]]
    docs = docs_of(spark, texts)
    samples = [(one(30), True) for _ in range(500)] + [(word(), False) for _ in range(500)]
    table = secretscan.train(spark.createDataFrame(samples, "token string, is_random boolean"))
    found = {r.doc_id: r.spans for r in secretscan.digest(secretscan.with_secrets(docs, table)).collect()}
    added = 0
    for i, text in enumerate(texts):
        more = markov_by_force(text, table)
        added += len(more)
        assert found[i] == ",".join(f"{secretscan.KINDS[k]}:{a}:{b}" for a, k, b in sorted([*spans_by_force(text), *more]))
    assert added > 20
    masked = {r.doc_id: r.text for r in secretscan.redacted(docs, table).collect()}
    for i, text in enumerate(texts):
        out, at = "", 0
        for a, _, b in sorted([*spans_by_force(text), *markov_by_force(text, table)]):
            if b > at:
                out, at = out + (text or "")[at : max(a, at)] + "[SECRET]", b
        assert masked[i] == out + (text or "")[at:]


def test_secrets_of_very_long_texts(spark):
    """A token of a million letters and fifty thousand strings of digits in one text, each within seconds."""
    rng = random.Random(2)
    hexes = ["".join(rng.choices("0123456789abcdef", k=28)) for _ in range(50_000)]
    texts = ["x" + "".join(rng.choices("ghijkXYZ0189", k=1_000_000)), " ".join(h + " some_ordinary_name_here" for h in hexes), " ", None]
    docs = docs_of(spark, texts)
    begun = time.time()
    rows = {r.doc_id: r for r in secretscan.digest(secretscan.with_secrets(docs, ",".join(["0.5"] * len(secretscan.ALPHABET) ** 2))).collect()}
    assert rows[1].n_hex == 50_000 and rows[1].spans.count("markov") == 50_000 and rows[0].spans == "markov:0:1000001"
    masked = {r.doc_id: r.text for r in secretscan.redacted(docs, None).collect()}
    assert masked[1] == " ".join("[SECRET] some_ordinary_name_here" for _ in hexes)
    secretscan.train(secretscan.labelled_samples(docs))
    assert time.time() - begun < 90


def test_secrets_of_nothing(spark):
    empty = docs_of(spark, ["x"]).limit(0)
    assert secretscan.train(secretscan.labelled_samples(empty)) is None
    assert secretscan.digest(secretscan.with_secrets(empty, None)).count() == 0 and secretscan.redacted(empty, None).count() == 0


# 8. Languages


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.filter(~queries.held_out()))
    rows = langid.predict(docs.filter(queries.held_out()), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs_of(spark, [None, "", "12 34 !", "—", "the of and that"]), model).collect()}
    assert [odd[k][0] for k in range(4)] == ["und"] * 4 and odd[4][0] == "en"
    texts = {lang: docs.filter(F.col("lang") == lang).first().text.split()[:40] for lang in ("en", "fr")}
    labels = [lang for _, lang in langid.label_words(" ".join(texts["en"] + texts["fr"]), model)]
    assert labels[:40].count("en") > 30 and labels[-40:].count("fr") > 30
    assert {r.lang_pred for r in langid.predict(docs_of(spark, ["abc"]), None).collect()} == {"und"}
    mixed = " ".join(texts["en"] + texts["fr"])
    rows = langid.predict(docs_of(spark, ["1", mixed, None, mixed, mixed]), model).collect()
    for r in rows:
        want = [x for _, x in langid.label_words(mixed, model)] if r.doc_id in (1, 3, 4) else []
        assert [x.lang for x in r.runs for _ in range(x.n)] == want and [x.first for x in r.runs] == list(np.cumsum([0] + [x.n for x in r.runs])[: len(r.runs)])
    assert langid.predict(docs.limit(0), model).count() == 0 and langid.fit(docs.limit(0)) is None


def test_chains_hold_every_word_once():
    bounds = np.array([0, 0, 5, 305, 306, 370, 500])
    chains = langid._spliced(bounds, np.random.default_rng(2))
    assert chains.shape == (1 + 5 + 1 + 1 + 3, langid.CHAIN)
    assert sorted(chains[chains >= 0].tolist()) == list(range(500))
    assert all((row >= 0).tolist() == sorted((row >= 0).tolist(), reverse=True) for row in chains)
    assert max(len(set(np.searchsorted(bounds, row[row >= 0], "right"))) for row in chains) > 1


def test_languages_of_short_texts_and_of_texts_without_spaces(spark):
    rng = random.Random(8)
    words = {"xx": [f"{a}{b}ka" for a in "bdg" for b in "aeiou"], "yy": [f"{a}{b}sch" for a in "bdg" for b in "aeiou"]}
    signs = {"zh": [chr(0x4E00 + k) for k in range(150)], "th": [chr(0x0E01 + k) for k in range(40)]}
    text = lambda lang, n: " ".join(rng.choices(words[lang], k=n)) if lang in words else "".join(rng.choices(signs[lang], k=5 * n))
    rows = [(text(lang, rng.randint(3, 40)), lang) for lang in ("xx", "zh", "th") for _ in range(40)]
    tests = [(text(lang, 12), lang) for lang in ("xx", "yy", "zh", "th") for _ in range(5)]
    for long in (0, 300):  # all documents are short; those of one language are long
        model = langid.train(*zip(*rows, *[(text("yy", long or 20), "yy") for _ in range(40)]))
        found = langid.predict(docs_of(spark, [t for t, _ in tests]), model).collect()
        assert {r.doc_id: r.lang_pred for r in found} == dict(enumerate(x for _, x in tests))
        assert min(r.score for r in found) > 0.6
    assert langid.train(["1 2 3"], ["xx"]) is None


def test_every_language_is_learned(spark):
    rng = random.Random(4)
    words = {f"l{k:02}": ["".join(rng.choices("abcdefghijklmnop", k=4)) for _ in range(12)] for k in range(40)}
    text = lambda x: " ".join(rng.choices(words[x], k=30))
    many = [(text(x), x) for x in words for _ in range(12)]
    docs = spark.createDataFrame([*many, *[(text("l00"), "l00") for _ in range(3000)]], "text string, lang string")
    model = langid.fit(docs, 400)
    assert model.languages == sorted(words)
    found = langid.predict(docs_of(spark, [text(x) for x in words]), model).collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id:02}" for r in found]) > 0.95
    sampled = lambda most: collections.Counter(r.lang for r in langid.sample(docs, most).collect())
    assert sampled(400) == {x: langid.LEAST_DOCS if x == "l00" else 12 for x in words}
    assert sampled(80_000) == {x: 2000 if x == "l00" else 12 for x in words}


def test_block_marginals_equal_the_whole_chain():
    rng = np.random.default_rng(4)
    e, a = rng.normal(size=(500, 3)), np.exp(rng.normal(size=(3, 3)))
    bounds = np.array([0, 0, 5, 305, 306, 500])
    got = langid.marginals(e, bounds, a)
    for low, high in zip(bounds[:-1], bounds[1:]):
        x = np.exp(e[low:high])
        alpha, state = [], np.full(3, 1 / 3)
        for row in x:
            state = (state @ a) * row
            state /= state.sum()
            alpha.append(state)
        beta, state = [], np.ones(3)
        for row in x[::-1]:
            beta.append(state)
            state = a @ (state * row)
            state /= state.sum()
        both = np.array(alpha).reshape(-1, 3) * np.array(beta[::-1]).reshape(-1, 3)
        assert np.allclose(got[low:high], both / both.sum(axis=1, keepdims=True) if len(both) else both)


# 9. Host rules


def test_quality_counts(spark, corpus):
    texts = [*corpus, "| a | b |\n| a | b |\n\n\n#", "x y z u v x y z u v w"]
    rows = hostrules.filtered(docs_of(spark, texts)).collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        counts = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        again = {k + j for k in range(len(words) - 4) if counts[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 10 or 100 * len(again) > 20 * len(words))


def test_bad_hosts_lose_their_documents(spark):
    good, bad = " ".join(f"w{k}" for k in range(30)), "short"
    texts = [good] * 200 + [bad] * 60 + [good] * 5 + [good]
    sources = ["fine"] * 200 + ["foul"] * 65 + [None]
    rows = hostrules.filtered(docs_of(spark, texts, sources)).collect()
    kept = {r.doc_id for r in rows if r.kept}
    assert kept == set(range(200)) | {265}
    assert hostrules.filtered(docs_of(spark, [good]).limit(0)).count() == 0


# 10. URLs


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://Example.ORG/es/1?x", "https://a.example.org/en/17#t", "http://x.com/fr/2", "http://x.com/de/2", "http://org", "http://ÀB.net?q=/fr/", "://", "http://notcom/fr/", "http://com/fr/a://b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = urlrep.judged(pages, urlrep.labelled_outcomes(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect()
    for r in rows:
        host, path = url_parts(urls[r.page_id])
        fits = [(len(h + p), h + p, v) for v, h, p in urlrep.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == (max(fits)[1:] if fits else (None, "allow"))


def test_reputation_shrinks_to_the_levels_above(spark):
    outcomes = [("good.net", False)] * 80 + [("bad.net", True)] * 60 + [("a.bad.net", True)] + [("few.net", True)] + [("unseen.net", None)]
    from loomspan.llm.shared import Workspace

    rows = {r.host: r for r in urlrep.reputation(spark.createDataFrame(outcomes, "host string, bad boolean"), Workspace(spark, "t")).collect()}
    assert rows["bad.net"].blocked and not rows["good.net"].blocked and not rows["few.net"].blocked
    assert rows["a.bad.net"].rate > rows["few.net"].rate > rows["good.net"].rate


def test_registered_domains(spark):
    hosts = {
        "a.b.example.co.uk": ("example.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "www.example.com:8080": ("example.com", "com"), "localhost": ("localhost", "localhost"),
        "192.168.1.7:80": ("192.168.1.7", "[]"), "[::1]:443": ("[::1]", "[]"), "": ("", ""), "1.2.3": ("2.3", "3"), "x.com.": ("com.", ""),
    }
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = urlrep.domain_and_suffix(F.col("host"))
    assert {r.host: (r.domain, r.suffix) for r in rows.select("host", domain.alias("domain"), suffix.alias("suffix")).collect()} == hosts


def test_urls_of_nothing_and_pages_twice(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "http://a.net/1"), (1, "http://a.net/1"), (None, None)], "page_id long, url string")
    assert urlrep.judged(pages, urlrep.labelled_outcomes(pages, none)).count() == 3
    empty = pages.limit(0)
    assert urlrep.judged(empty, urlrep.labelled_outcomes(empty, none)).count() == 0


# Shared parts


def test_scanner_words_and_grams(corpus):
    alphabet = textscan.unspaced(lower=True)
    names = {}
    for text, hashes in zip(corpus, textscan.hash_words([t or "" for t in corpus], alphabet)):
        words = (text or "").encode().lower().split()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    for part in textscan.slices(pa.array(corpus, pa.string()), alphabet, most=500):
        at, grams = part.grams(3)
        assert len(at) == sum(max(0, n - 2) for n in np.diff(part.bounds()))


def test_pipeline(spark):
    import corpus_pipeline

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]
    docs = documents
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, SF)
        assert docs.columns == documents.columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage{k}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    assert 0 < docs.count() < documents.count()
    texts = [r.text for r in docs.collect()]
    assert len({c for _, c in linked_by_force(texts).values()}) == len(texts)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(x[-1] for x in contaminated_by_force(texts, items, 10).values())
    assert not any(spans_by_force(t) for t in texts)
    rows = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in rows.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_near_copies_that_pivots_do_not_separate(spark, monkeypatch):
    """The stage's large regions are not copied to all pivots, and it keeps one document of each linked group."""
    import corpus_pipeline

    texts, rows = near_copies(240, 16, seed=31), collections.Counter()
    table, linked = jaccard.Workspace.table, jaccard.linked

    def counted(self, df, name):
        out = table(self, df, name)
        rows[name] = out.count() if name.startswith("members") else 0
        return out

    monkeypatch.setattr(jaccard, "LEVELS", 2)
    monkeypatch.setattr(jaccard.Workspace, "table", counted)
    monkeypatch.setattr(jaccard, "linked", lambda docs, **stage: linked(docs, most=30_000, **stage))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs_of(spark, texts), SF).collect()}
    assert kept == {c for _, c in linked_by_force(texts, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT).values()}
    assert rows["members0"] and rows["members1"] <= 3 * rows["members0"], rows


def test_pipeline_links_five_words_at_four_fifths(spark):
    import corpus_pipeline

    rng = random.Random(11)
    make = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    base = make(100)
    edited = make(280)
    copy = list(edited)
    for k in (30, 80, 130, 180, 230, 260):  # 2.14% of the words: 0.808 at five words, 0.842 at four
        copy[k] = "edit"
    texts = [base, base + make(22), make(22) + base, base + make(30), edited, copy, make(50), make(3)]
    texts = [" ".join(t) for t in texts]
    forced = linked_by_force(texts, 5, 80)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs_of(spark, texts), SF).collect()}
    assert kept == {c for _, c in forced.values()} == {0, 3, 4, 6, 7}
    assert len({c for _, c in linked_by_force(texts).values()}) == len(texts)


def test_pipeline_decontaminates_rows_not_ids(spark):
    import corpus_pipeline

    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 200").first().text
    rows = [(None, f"before {item} after"), (None, "clean one"), (None, "clean two"), (None, None), (7, item), (7, "clean three"), (8, "clean three"), (9, item), (9, item)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], DOCS).repartition(3)
    kept = corpus_pipeline.decontaminate(spark, docs, SF)
    assert kept.columns == docs.columns
    found = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert found == collections.Counter((i, t) for i, t in rows if item not in (t or ""))


def tables_of(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, component_id long, spans string, h long, size long, piece int, sequence_id long, hit string, stays string"


def test_pipeline_of_odd_rows(spark, corpus, tmp_path):
    import corpus_pipeline

    passage = "one two three four five six seven eight nine ten eleven"
    texts = [*corpus[:12], *corpus[-6:-2], f"before {passage} after"]
    rows = [*enumerate(texts), *[(3, texts[3])] * 3, (None, None), (None, ""), (None, "null id alone here with six words"), (2000, None), (2001, ""), (2002, " \n")]
    wide = [(i, t, None, None, None, 1, "x", 2, 3, 4, 5, "y", "z") for i, t in rows]
    docs = spark.createDataFrame(wide, CLASHING).repartition(3)
    folder = tables_of(spark, tmp_path / "odd", docs, [(None, 5, 0), (1, None, None)], [(1, passage), (2, None), (3, "")])
    groups = linked_by_force([t for _, t in rows], 5, 80)
    firsts = {root for n, (_, root) in groups.items()}
    stay = {(i, t) for n, (i, t) in enumerate(rows) if n in firsts}
    want = collections.Counter((i, t) for i, t in stay if passage not in (t or ""))
    kept = docs
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.decontaminate):
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()) == want


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    docs = docs_of(spark, ["x"]).limit(0)
    folder = tables_of(spark, tmp_path / "none", docs, [], [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns and kept.count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0
