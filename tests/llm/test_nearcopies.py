"""Near copies of the pipeline against all pairs by brute force."""

import random

import numpy as np

import corpus_pipeline
from paperloom.llm import nearcopies


def edited_docs():
    """Originals with lightly edited copies, copies under the limit, short, empty and null texts; one crowded group."""
    draw, rows = random.Random(7), []
    words = [f"w{i}" for i in range(5000)]
    for k in range(12):
        base = draw.choices(words, k=400)
        rows.append(" ".join(base))
        for changes in [4, 6, 8, 8, 12, 20, 40] + ([3] * 40 if k == 0 else []):
            text = list(base)
            for at in draw.sample(range(400), changes):
                text[at] = draw.choice(words)
            rows.append(" ".join(text))
    rows += [None, "", " ", "a b", "A  b", "a b c", rows[0], rows[0].upper()]
    draw.shuffle(rows)
    return list(enumerate(rows))


def shingles(text):
    own = (text or "").lower().split()
    return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))}


def test_one_of_each_group_by_brute_force(spark):
    rows = edited_docs()
    sets = [shingles(t) for _, t in rows]
    low = list(range(len(rows)))
    near = [[j for j in low if 5 * len(s & sets[j]) >= 4 * len(s | sets[j])] for s in sets]
    for _ in rows:
        low = [min(low[j] for j in js) for js in near]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.keep_one_of_group(spark, docs, "").collect()}
    assert got == set(low)
    assert {r.doc_id for r in nearcopies.keep_first(docs, crowd=1000).collect()} == set(low)


def test_fingerprints_by_plain_counting():
    """A bit of a fingerprint is 1 if over half of the shingles have it; segments are its bits, one after the other."""
    draw = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 9, 100, 5000):
        hashes = draw.integers(0, 1 << 63, n).astype("<u8")
        words = nearcopies.fingerprint_words(14)
        ones = np.unpackbits(nearcopies.expanded(hashes, words).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=int)
        own = nearcopies.fingerprint(hashes, words)
        bits = (2 * ones > n).astype(int).tolist()
        assert np.unpackbits(own.view(np.uint8), bitorder="little").tolist() == bits
        got = nearcopies.segments(own[None, :], 14)[0].tolist()
        assert got == [sum(bits[128 + 14 * k + j] << j for j in range(14)) for k in range(72)]


def test_texts_at_the_limit_meet_in_the_index(spark):
    """Of 300 pairs at a similarity of 0.8 all are linked; they differ in as many bits as the segments are made for."""
    draw, rows, shares = random.Random(5), [], []
    for _ in range(300):
        base = [draw.randrange(10**6) for _ in range(94)]
        other = [*base[:84], *(draw.randrange(10**6) for _ in range(10))]
        rows += [" ".join(map(str, base)), " ".join(map(str, other))]
        a, b = (nearcopies.shingle_hashes(t) for t in rows[-2:])
        common = len(np.intersect1d(a, b))
        assert 5 * common == 4 * (len(a) + len(b) - common)
        x, y = (nearcopies.fingerprint(h, 40) for h in (a, b))
        shares.append(np.bitwise_count(x ^ y).sum() / 2560)
    assert max(shares) < nearcopies.near_bits(2560) / 2560
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_group(spark, docs, "").collect()} == set(range(0, 600, 2))


def test_pairs_of_crowded_entries_without_a_leader(spark):
    """Texts of one base, near only where they lack the same words of it: they share what all the others share too."""
    draw, rows = random.Random(11), []
    for k, places in enumerate(draw.sample([(p, q) for p in range(5, 115, 5) for q in range(p + 5, 115, 5)], 40)):
        rows += [" ".join(f"x{k} {copy} {at}".replace(" ", "-") if at in places else f"w{at}" for at in range(120)) for copy in range(3)]
    draw.shuffle(rows)
    sets = [shingles(t) for t in rows]
    low = [min(j for j, t in enumerate(sets) if 5 * len(s & t) >= 4 * len(s | t)) for s in sets]
    assert len(set(low)) == 40
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    for crowd in (2, nearcopies.CROWD, 1000):
        assert {r.doc_id for r in nearcopies.keep_first(docs, crowd=crowd).collect()} == set(low)


def exploded(df):
    """Rows that come out of the explode nodes that keep ``entry`` when ``df`` is run."""

    def nodes(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return nodes(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return nodes(plan.plan())
        children = plan.children()
        own = [plan] if kind == "GenerateExec" and "entry" in [a.name() for a in items(plan.requiredChildOutput())] else []
        return own + [n for child in items(children) for n in nodes(child)]

    def items(seq):
        return [seq.apply(k) for k in range(seq.size())]

    df.collect()
    return sum(n.metrics().apply("numOutputRows").value() for n in nodes(df._jdf.queryExecution().executedPlan()))


def crowded_texts(spark):
    """Signatures of 60 near copies of one text and of 8 further from it, which share entries with them."""
    draw = random.Random(13)
    base, rows = [f"w{at}" for at in range(400)], []
    for k, changes in enumerate([2] * 60 + [16, 20, 24, 28] * 2):
        text = list(base)
        for at in draw.sample(range(400), changes):
            text[at] = f"x{k}-{at}"
        rows.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return nearcopies.materialize(nearcopies.signatures(docs, 12).select("text_key", "n", "fp", "segments"), "test-distinct")


def test_leaders_are_not_repeated_beyond_the_texts_of_their_entries(spark):
    """Leaders have no more rows than it takes for the texts of their entries, few where they are few."""
    distinct = crowded_texts(spark)
    pairs, many = nearcopies.candidates(distinct)
    held = [r["count"] for r in many.groupBy("entry").count().collect()]
    assert min(held) > nearcopies.CROWD
    assert exploded(pairs) <= sum(-(-n // nearcopies.BLOCK) for n in held)


def test_blocks_of_crowded_entries(spark, monkeypatch):
    """Entries in many blocks: the same candidates and pairs as in one, and only texts outside the largest component are repeated."""
    distinct = crowded_texts(spark)
    near = {r.text_key for r in distinct.where("n > 0").collect()}
    words, got = nearcopies.fingerprint_words(12), []
    for block in (256, 4):
        monkeypatch.setattr(nearcopies, "BLOCK", block)
        pairs, many = nearcopies.candidates(distinct)
        links = nearcopies.near_pairs(distinct, pairs, words)
        # One component of all but six texts.
        apart = set(sorted(near)[:6])
        parts = nearcopies.materialize(distinct.selectExpr("text_key", f"CASE WHEN text_key IN ({', '.join(map(str, apart))}) THEN text_key ELSE 0L END AS group_key"), "test-parts")
        met = nearcopies.pairs_apart(distinct, many, parts, words)
        got.append([{(r.a, r.b) for r in df.collect()} for df in (pairs, links, met)])
        entries = {}
        for r in many.collect():
            entries.setdefault(r.entry, []).append(r.text_key)
        outside = {e: len(apart & set(keys)) for e, keys in entries.items()}
        # The largest component of an entry may be a text of its own only where none of the others is there.
        assert all(len(keys) > outside[e] + 1 for e, keys in entries.items())
        assert exploded(met) == sum(outside[e] * -(-len(keys) // block) for e, keys in entries.items())
    assert got[0] == got[1]
    assert all(got[0])
