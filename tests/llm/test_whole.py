"""Cases in which an operator once did less than its whole job."""

import random

import corpus_pipeline
from chronocite.llm import line_dedup, near_copies, simhash
from chronocite.llm.common import Scratch
from chronocite.llm.words import Tokens

from . import brute


def prose(seed, n=120):
    rng = random.Random(seed)
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def test_one_document_of_every_component_stays(spark):
    a, b, c, d, e = (" ".join(prose(k)) for k in range(5))
    # components of null ids only, two texts under one id, and a null id beside a known one
    made = [(None, a), (None, a), (None, b), (None, c), (7, d), (7, e), (9, d), (None, e)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    kept = simhash.keep_first(df, Scratch(spark, "t")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, a), (0, b), (0, c), (7, d), (7, e)])


def word_sets(text, size=5):
    w = text.lower().split()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def near_groups(made):
    """Row numbers by group: links of shingle similarity 4/5 or more."""
    sets, root = [word_sets(t) for _, t in made], list(range(len(made)))
    for k, a in enumerate(sets):
        for j in range(k):
            c = len(a & sets[j])
            if 5 * c >= 4 * (len(a) + len(sets[j]) - c):
                old, new = root[k], root[j]
                root = [new if r == old else r for r in root]
    found = {}
    for k, r in enumerate(root):
        found.setdefault(r, []).append(k)
    return sorted(found.values())


def planted():
    """Copies with some words changed, at similarities around 0.8, of texts
    that share a common passage."""
    rng = random.Random(11)
    passage, made = prose(99, 30), []
    for g in range(25):
        base = prose(1000 + g, rng.choice([60, 150, 400])) + passage
        for _ in range(rng.choice([1, 3, 6])):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 20)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            made.append((len(made), " ".join(w)))
    made += [(len(made), " ".join(passage)), (len(made) + 1, ""), (len(made) + 2, "one two"), (len(made) + 3, "One  TWO"), (len(made) + 4, " ")]
    return made


def test_near_dedup_is_the_exact_similarity(spark):
    made = planted()
    df = spark.createDataFrame(made, "doc_id long, text string")
    want = near_groups(made)
    assert 30 < len(want) < len(made) - 20
    got = {}
    for r in near_copies.groups(df, Scratch(spark, "t")).collect():
        got.setdefault(r.root, []).append(r.doc_id)
    assert sorted(map(sorted, got.values())) == want
    kept = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(g[0] for g in want)


def test_short_lines_are_judged(spark):
    rng = random.Random(4)
    made = [(0, "a b c d\n目次のない行\n\nbuy buy buy\nTwo words"), (1, "a b c d e\nbuy\n目次のない行\n\ntwo WORDS\nc b a d"), (2, "a b c\na b c x"), (None, "buy")]
    made += [(d, "\n".join(" ".join(rng.choice("pqrst") for _ in range(rng.randrange(7))) for _ in range(6))) for d in range(3, 30)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    want = brute.similar_lines(made, 1)
    assert {(1, 0), (1, 1), (1, 2), (1, 4), (1, 5)} <= want and not {(2, 0), (2, 1)} & want
    assert {(r.doc, r.no) for r in line_dedup.removals(df, Scratch(spark, "t"), least=1).collect()} == want
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, df, "").collect()}
    assert left == {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in want) for d, t in made}


def test_near_dedup_goes_by_fingerprints(spark, monkeypatch):
    made = [(d, t) for d, t in planted()]
    # long texts with a word changed keep near bits; equal bits of another set; a repeat changes bits, not the set
    long = [prose(500 + k, 1500) for k in range(8)]
    for w in long:
        made += [(len(made), " ".join(w)), (len(made) + 1, " ".join([*w[:700], "changed", *w[701:]]))]
    made += [(len(made), "r s t u v r s t u v r s t u v"), (len(made) + 1, " ".join("r s t u v".split() * 9))]
    df = spark.createDataFrame(made, "doc_id long, text string")
    met, asked = near_copies.near_links, []

    def seen(distinct, *given):
        asked.append({r.fp for r in distinct.collect()})
        return met(distinct, *given)

    monkeypatch.setattr(near_copies, "near_links", seen)
    kept = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert asked == [{simhash.fingerprint(t, 5) for _, t in made}]
    assert sorted(r.doc_id for r in kept) == sorted(g[0] for g in near_groups(made))
    order = near_copies.np.zeros(near_copies.BINS, near_copies.np.uint8)
    keys = [near_copies.keyed(t, 5, order)[:2] for _, t in made]
    rows = spark.createDataFrame(keys, "h long, fp long")
    got = {frozenset((r.u, r.v)) for r in near_copies.proposed(rows, Scratch(spark, "t")).collect()}
    near = {frozenset((a, b)) for a, x in keys for b, y in keys if a != b and int(x ^ y & (1 << 64) - 1).bit_count() <= simhash.LIMIT}
    assert got <= near and len(got) > 4


def test_vocabulary_is_in_order_of_appearance():
    texts = [b"", b" b a  B\tc", b"\n \x0b", "é a\x1cx É zz".encode(), b"c a", b""]
    for fold in (True, False):
        want = [w.lower() if fold else w for t in texts for w in t.split()]
        words, which, of = Tokens(fold).vocabulary(texts)
        assert words == list(dict.fromkeys(want)) and [words[k] for k in which] == want
        assert of.tolist() == [k for k, t in enumerate(texts) for _ in t.split()]
        assert Tokens(fold).vocabulary([b"", b" "])[0] == [] == Tokens(fold).vocabulary([b"", b" "])[1].tolist()
