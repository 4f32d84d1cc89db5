"""Each query against its brute-force version, on the small tables and on odd rows."""

import json

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronocite.llm import byte_bpe, decontaminate, hmm_lm, quality_gam, queries, simhash, substring, token_store
from chronocite.llm.common import Scratch, fold

from . import brute

SF = "/root/testdata/sf0.001"
key = lambda r: tuple((x is not None, x) for x in r)


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=key)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_op2(spark, real):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = rows(queries.op2_benchmark_decontamination(spark, SF), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.contamination(pairs(real), [(r.item_id, r.text) for r in items.collect()]))


def test_decontamination_of_odd_rows_and_shards(spark, docs):
    items = spark.createDataFrame([(1, "quick brown FOX"), (1, "best of times"), (2, ""), (3, None), (None, "lazy dog"), (20, "w0 w1 w4 w9 w16 w25 w36 w49 w64 w81 w100 w121 w144 w169 w196")], "item_id long, text string")
    want = sorted(brute.contamination(pairs(docs), [(r.item_id, r.text) for r in items.collect() if r.item_id is not None]), key=key)
    for limit in (1 << 20, 30):
        h = decontaminate.hits(items, F.col("text"), shard_bytes=limit)
        got = docs.select("doc_id", h.alias("h")).select("doc_id", "h.n_words", "h.n_hit", F.size("h.items").alias("n"), F.sha2(F.array_join("h.items", ","), 256).alias("s"), decontaminate.contaminated(F.col("h")).alias("c"))
        assert sorted(map(tuple, got.collect()), key=key) == want
    spans = docs.where("doc_id = 1").select("text", h.alias("h")).first()
    assert [spans.text[s.begin : s.end] for s in spans.h.spans] == ["quick brown fox", "best of times"]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert docs.select(decontaminate.hits(empty, F.col("text")).alias("h")).where("h.n_hit > 0").count() == 0


def test_op3(spark, real, docs):
    got = {r[0]: r for r in rows(queries.op3_lm_scoring(spark, SF), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
    better = 0.0
    for want in brute.base_scores(pairs(real)):
        r = got[want[0]]
        assert r[:5] == want[:5]
        assert r[5] == pytest.approx(want[5], rel=1e-9)
        better += (r[6] - r[5]) * want[1]
    assert better > 0  # on held-out texts


def test_lm_odd_rows(spark, docs):
    got = hmm_lm.score(docs, fold("doc_id", 5) == 1, Scratch(spark, "t"))
    want = sorted(((w[0], *w[2:5], round(w[5], 6)) for w in brute.base_scores(pairs(docs))), key=key)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.collect()), key=key) == want
    assert hmm_lm.score(docs.limit(0), F.lit(False), Scratch(spark, "t")).count() == 0
    assert hmm_lm.score(docs, F.lit(True), Scratch(spark, "t")).where("score > 0 or n_known > 0").count() == 0


def test_score_sums_all_paths(spark):
    import itertools
    import math
    from collections import Counter

    made = [(k, t) for k, t in enumerate(["a b a", "b c", "", "C a a B", "c c", None, "a d", "b a c"])]
    df = spark.createDataFrame(made, "doc_id long, text string")
    held = F.col("doc_id") >= 6
    training = df.where(~held).select(F.coalesce("text", F.lit("")).alias("text"))
    got = hmm_lm.learned(training, hmm_lm.token_counts(training), states=2, rounds=2)
    count = Counter(w for k, t in made if k < 6 for w in hmm_lm.tokens(t))
    end, m, want = len(got.model.top), got.model, {}
    for k, t in made:
        w, prob = hmm_lm.tokens(t), 0.0
        seq = [*hmm_lm.classes_of(w, m.top).tolist(), end]
        for path in itertools.product(range(2), repeat=len(seq)):
            p = m.start[path[0]]
            for i, (s, c) in enumerate(zip(path, seq, strict=True)):
                p *= (m.step[path[i - 1], s] if i else 1.0) * m.emit[c, s]
            prob += p
        for x, c in zip([*w, None], seq, strict=True):
            n, v = got.n_class[c], got.v_class[c]
            seen = 6 if x is None else count[x]
            prob *= (1.0 if not n else (seen - 0.5) / n if seen else 0.5 * v / n)
        want[k] = math.log10(prob)
    scored = {r.doc_id: r.score for r in hmm_lm.score(df, held, Scratch(spark, "t"), states=2, rounds=2).collect()}
    assert scored == pytest.approx(want)


def test_training_texts_are_tokenised_once(spark, docs, monkeypatch):
    made, seen = hmm_lm.classed, []
    monkeypatch.setattr(hmm_lm, "classed", lambda texts, top: seen.append(top) or made(texts, top))
    training = docs.select("text")
    counts = hmm_lm.token_counts(training)
    scratch = Scratch(spark, "t")
    got, plain = hmm_lm.learned(training, counts, scratch, rounds=3), hmm_lm.learned(training, counts, rounds=3)
    assert len(seen) == 2 and seen[0] == seen[1]
    for a, b in ((got.model.start, plain.model.start), (got.model.step, plain.model.step), (got.model.emit, plain.model.emit)):
        np.testing.assert_allclose(a, b, rtol=1e-9)
    for r, text in zip(made(training, seen[0]).collect(), training.collect(), strict=True):
        words = hmm_lm.tokens(text.text)
        assert np.frombuffer(r.classes, hmm_lm.CLASS).tolist() == [*hmm_lm.classes_of(words, seen[0]).tolist(), len(seen[0])]
    where = spark._jvm.org.apache.hadoop.fs.Path(scratch.path("classes"))
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)  # dropped when read


def test_forward_is_exact():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    m = hmm_lm.Model(norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((3, 5))).T.copy(), {})
    seqs = [np.array(s) for s in ([4, 0, 2, 1], [1, 3], [2])]
    for s, got in zip(seqs, hmm_lm.forward(m, *hmm_lm.laid_out(seqs)), strict=True):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.step[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            total += p
        assert got == pytest.approx(np.log(total))


def test_training_raises_likelihood():
    import numpy as np

    rng = np.random.default_rng(2)
    seqs = sorted((rng.integers(0, 6, n) for n in rng.integers(5, 40, 50)), key=lambda s: -len(s))
    base = np.full(6, 1 / 6)
    m, last = hmm_lm.start_model(np.full(6, 10.0), {}, 2), -np.inf
    for _ in range(4):
        now = hmm_lm.forward(m, *hmm_lm.laid_out(seqs)).sum()
        assert now > last
        last = now
        c = {"start": np.zeros(2), "step": np.zeros((2, 2)), "emit": np.zeros((6, 2))}
        hmm_lm.expected(m, *hmm_lm.laid_out(seqs), c)
        assert c["emit"].sum() == pytest.approx(sum(map(len, seqs)))
        m = hmm_lm.maximised(m, c, base * 1e-3)


def test_op5(spark, real):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = rows(queries.op5_token_store(spark, SF), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == brute.token_rows(sorted(pairs(real)), t)


def test_store_round_trip_and_faults(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    root = Scratch(spark, "store").root
    with open(path, encoding="utf-8") as f:
        token_store.write(docs, root, f.read())
    got = token_store.read_ids(spark, root).orderBy("start").collect()
    in_order = sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [(r.doc_id, list(r.ids)) for r in got] == [(d, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for d, x in in_order]
    assert token_store.verify(spark, root).count() == 0
    assert spark.read.parquet(f"{root}/chunks").groupBy("hash").count().where("count > 1").count() == 0
    broken = spark.read.parquet(f"{root}/chunks").withColumn("hash", F.unhex(F.sha2("hash", 256)))
    with pytest.raises(Exception, match="does not have its content"):
        token_store.chunk_digests(broken).collect()
    held = lambda name: spark.createDataFrame((x := spark.read.parquet(f"{root}/{name}")).collect(), x.schema)
    kept, chunks, was = held("recipes"), held("chunks"), held("manifest")
    assert kept.where("size(hashes) > 1").count() and chunks.count() and was.count()
    swapped = kept.withColumn("hashes", F.reverse("hashes"))
    swapped_and_rooted = swapped.withColumn("root", F.sha2(F.unhex(F.array_join(F.transform("hashes", F.hex), "")), 256))
    assert swapped_and_rooted.where("size(hashes) < 2").exceptAll(kept).count() == 0
    faults = {
        "recipes": (kept, [swapped, swapped_and_rooted, kept.withColumn("root", F.sha2("root", 256)), kept.withColumn("start", F.col("start") + 1), kept.where("n_tokens < 1000")]),
        "manifest": (was, [was.withColumn("root", F.sha2("root", 256)), was.limit(was.count() - 1), was.withColumn("ids", F.col("ids") + 1)]),
        "chunks": (chunks, [chunks.orderBy("hash").offset(1)]),
    }
    for name, (sound, changed) in faults.items():
        for fault in changed:
            fault.write.mode("overwrite").parquet(f"{root}/{name}")
            for read in (token_store.read_digests, token_store.read_ids):
                with pytest.raises(Exception, match="differ from the manifest" if name != "chunks" else "missing"):
                    read(spark, root).collect()
        sound.write.mode("overwrite").parquet(f"{root}/{name}")
    assert token_store.read_digests(spark, root).count() == docs.count()
    token_store.write(docs.limit(0), f"{root}/none", open(path, encoding="utf-8").read())
    assert token_store.read_digests(spark, f"{root}/none").count() == 0


def test_word_coder_holds_for_its_tokenizer_only():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        made = json.load(f)
    texts = ["Hello World", "", "a<|endoftext|>b <|ENDOFTEXT|> it's É é\u00a0x\x1cy 12,3!? hello hello,", "日本語 \t x"]
    plain = {k: v for k, v in made.items()}
    without = made | {"normalizer": {"type": "Sequence", "normalizers": made["normalizer"]["normalizers"][:2]}}
    for spec in (plain, without):
        coder, t = token_store.WordCoder(json.dumps(spec)), Tokenizer.from_str(json.dumps(spec))
        ids, ends = coder.ids_of([x.encode() for x in texts], 1)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]
        assert coder.by_word is (spec is plain)


@pytest.mark.parametrize("slots, pool, held", [(20, 1 << 12, 100), (3, 1 << 12, 4), (20, 32, 4)])
def test_word_coder_remembers_right(monkeypatch, slots, pool, held):
    monkeypatch.setattr(token_store, "SLOT_BITS", slots)
    monkeypatch.setattr(token_store, "POOL", pool)
    monkeypatch.setattr(token_store, "REMEMBERED", held)
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        coder, t = token_store.WordCoder(f.read()), Tokenizer.from_file(path)
    asked, coded = [], coder.coded
    monkeypatch.setattr(coder, "coded", lambda words: asked.extend(words) or coded(words))
    for k in range(40):  # old words beside new ones, in many buffers
        texts = [f"common, Straße ÀÉ don't 12 new{k} n\u00ea{'x' * k}w!? {'long' * (k % 3) * 30}", "", f"common common {k}"]
        ids, ends = coder.ids_of([x.encode() for x in texts], 1)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]
    if (slots, pool) == (20, 1 << 12):  # much more is met than REMEMBERED, and nothing is coded twice
        assert len(asked) == len(set(asked)) > held


def test_op6(spark, real, docs):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        raw = f.read()
    ranks = byte_bpe.ranks(raw)
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert rows(queries.op6_byte_bpe(spark, SF), *names) == sorted(brute.bpe_rows(pairs(real), ranks, public_tokenizers.PATTERN))
    c = docs.select("doc_id", byte_bpe.coded(spark, F.col("text"), raw, public_tokenizers.PATTERN).alias("c")).select("doc_id", "c.n_tokens", F.sha2("c.ids", 256).alias("ids_sha256"), F.sha2("c.decoded", 256).alias("decoded_sha256"))
    assert rows(c, *names) == sorted(brute.bpe_rows(pairs(docs), ranks, public_tokenizers.PATTERN), key=key)


def test_overlapping_chunks_give_one_pass():
    import random

    rng = random.Random(1)
    for _ in range(500):
        x = "".join(rng.choice([" ", "  ", "\n", "a", "be", "'s", "1", "!", "é", "\t", "日", "\u0085", "\x1c"]) for _ in range(rng.randrange(60)))
        for chunk, overlap in ((7, 3), (16, 8)):
            assert byte_bpe.stitched(x, chunk, overlap) == byte_bpe.pieces(x)


def test_op7_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op7_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").select((F.col("predicted") == F.col("quality")).alias("ok")).collect()
    assert sum(r.ok for r in got) >= 0.97 * len(got)


def test_classifier_odd_rows(spark, docs):
    none = quality_gam.train(docs.limit(0).withColumn("quality", F.lit(1)))
    one = quality_gam.train(docs.withColumn("quality", F.lit(1)))
    both = quality_gam.train(docs.withColumn("quality", F.when(F.length("text") > 100, 1).otherwise(0)), max_rows=8)
    for model in (none, one, both):
        got = docs.withColumn("score", quality_gam.score(docs, model, F.col("text"))).collect()
        assert len(got) == len(docs.collect()) and all(0 <= r.score <= 1 for r in got)


def test_op8(spark, real):
    got = rows(queries.op8_simhash_near_dedup(spark, SF), "doc_id", "fingerprint", "component_id")
    assert got == sorted(brute.near_groups(pairs(real)))


def test_simhash_odd_rows(spark, docs):
    got = simhash.groups(docs, Scratch(spark, "t")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("f"), "component_id")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute.near_groups(pairs(docs)), key=key)
    kept = simhash.keep_first(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    first = {c for _, _, c in brute.near_groups(pairs(docs))}
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: x or -1) == sorted(first, key=lambda x: x or -1)


def test_no_link_is_lost_among_planted_fingerprints(spark):
    import random

    import numpy as np

    rng = random.Random(5)
    prints = []
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 60])):
            prints.append(f)
            for _ in range(rng.randrange(6)):
                f ^= 1 << rng.randrange(64)
    ids = list(dict.fromkeys(prints))
    want = brute.near_groups([(k, None) for k in range(len(ids))], prints=ids)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in ids], "fp long")
    from chronocite.llm.components import components

    for size in (10, 10**6, 10**9):
        linked = {r.node: r.root for r in components(simhash.near_links(df, size), Scratch(spark, "t")).collect()}
        signed = {int(np.uint64(x).astype(np.int64)): c for x, (_, _, c) in zip(ids, want, strict=True)}
        groups = {}
        for f, c in signed.items():
            groups.setdefault(c, set()).add(linked.get(f, f))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_op10(spark, real, docs):
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows(queries.op10_substring_dedup(spark, SF), *names) == sorted(brute.substring_rows(pairs(real)))
    gone = substring.removals(docs, Scratch(spark, "t"))
    left = docs.join(gone, "doc_id", "left").select("doc_id", substring.digests(F.col("text"), F.col("gone")).alias("k")).select("doc_id", "k.*")
    assert rows(left, *names) == sorted(brute.substring_rows(pairs(docs)), key=key)


def test_substrings_planted(spark):
    import random

    rng = random.Random(9)
    passage = [f"p{k}" for k in range(120)]
    made = []
    for d in range(60):
        w = [f"u{rng.randrange(400)}" for _ in range(rng.randrange(20, 90))]
        if d % 2:
            a = rng.randrange(60)
            w[10:10] = passage[a : a + rng.randrange(45, 61)]
        made.append((d, " ".join(w)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    gone = substring.removals(df, Scratch(spark, "t"))
    left = df.join(gone, "doc_id", "left").select("doc_id", substring.digests(F.col("text"), F.col("gone")).alias("k")).select("doc_id", "k.*")
    assert rows(left, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring_rows(made))
