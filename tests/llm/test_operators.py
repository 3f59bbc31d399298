"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import importlib.util
import random
import shutil

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.llm import hamming, line_dedup, mixing, neighbour_votes, packing, piece_counts, quality, simhash_dedup, span_hashes, token_blocks, vectext, vocabulary
from heronry.llm.groups import connected

WORDS = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("ani", "oru", "elta", "isto", "umber")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, sig long, n_tokens string, k int, _id int"


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def tricky(spark, extra=()):
    rng = random.Random(8)
    base = prose(rng, 300)
    near = base.split()
    near[5] = "different"
    texts = [base, base, " ".join(near), "", None, "   ", "!?", "a", "Ünïcode straße " * 40, prose(rng, 20), prose(rng, 500), "x" * 30_000 + " end", "\n".join(prose(rng, 9) for _ in range(200))]
    texts += [prose(rng, rng.randint(5, 200)) + "." for _ in range(20)] + list(extra)
    rows = [(k, t, "en", None if k % 11 == 3 else f"s{k % 4}", len(t or ""), "row", 1, "t", 2, 3) for k, t in enumerate(texts)]
    rows += [rows[9], (None, base, "en", "s1", len(base), "row", 1, "t", 2, 3), (None, None, None, None, None, "row", 1, "t", 2, 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def same_as_sql(frame, sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    cur = con.execute(sql)
    names = sorted(d[0] for d in cur.description)
    order = [[d[0] for d in cur.description].index(c) for c in names]
    assert names == sorted(frame.columns)
    key = lambda row: tuple(repr(round(x, 9) if isinstance(x, float) else x) for x in row)
    assert sorted(key([r[c] for c in names]) for r in frame.collect()) == sorted(key([r[i] for i in order]) for r in cur.fetchall())


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1


def test_mixing_equals_sql(spark):
    docs, _ = tricky(spark)
    same_as_sql(mixing.mix(docs), mixing.SQL, documents=docs)
    assert mixing.mix(empty(spark)).collect() == [] and mixing.mixed(empty(spark)).columns == docs.columns


def test_mixing_weights():
    tokens = [1000, 100, 10]
    a = mixing.exponent(tokens, 1110 * 1.25)
    repeats = [w * 1110 * 1.25 / t for w, t in zip(mixing.weights(tokens, a), tokens)]
    assert max(repeats) <= 1.5 < max(w * 1110 * 1.25 / t for w, t in zip(mixing.weights(tokens, a - 2e-6), tokens))
    b = mixing.exponent(tokens, 1110, target_entropy=0.8)
    goal = 0.8 * np.log(3)
    assert mixing.entropy(mixing.weights(tokens, b)) >= goal - 1e-9 and mixing.entropy(mixing.weights(tokens, b + 2e-6)) < goal
    with pytest.raises(ValueError):
        mixing.exponent(tokens, 1110 * 2)


def test_mixed_is_mix(spark):
    docs, _ = tricky(spark)
    want = {(r.doc_id, r.source): r["count"] for r in mixing.mix(docs).groupBy("doc_id", "source").count().collect()}
    got = {(r.doc_id, r.source): r["count"] for r in mixing.mixed(docs).groupBy("doc_id", "source").count().collect()}
    assert got == want and mixing.mixed(docs).columns == docs.columns
    order = [r.doc_id for r in mixing.mix(docs, block_tokens=500).orderBy("block", "place").collect()]
    assert [r.doc_id for r in mixing.mixed(docs, block_tokens=500).collect()] == order


# --- bytes


def collide():
    """Two words whose polynomials are equal modulo 2 ** 64 in every odd base."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    return a, b


def test_runs_of_bytes_are_told_apart():
    import pyarrow as pa

    a, b = collide()
    (p,) = vectext.pieces(pa.array([a, b, a]))
    assert p.hash[0] == p.hash[2] != p.hash[1]
    rng = random.Random(2)
    runs = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 7, 8, 9, 17, 40, 300]))) for _ in range(400)]
    data = np.frombuffer(b"".join(runs), np.uint8)
    end = np.cumsum([len(r) for r in runs])
    start = end - [len(r) for r in runs]
    sample, which = vectext.named(data, start, end, np.array([len(r) % 3 for r in runs], np.uint64))  # hashes that collide
    assert [runs[k] for k in sample[which]] == runs and len(sample) == len(set(runs))
    long = ["q" * 70_000 + " " + "q" * 70_000 + " r" + "q" * 70_000]
    (p,) = vectext.pieces(pa.array(long))
    assert p.hash[0] == p.hash[1] != p.hash[2]


def test_words_that_collide_modulo_two_to_the_64(spark):
    a, b = collide()
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    got = {r.doc_id: r for r in span_hashes.spans(docs, spark.createDataFrame([], "item_id long, text string")).collect()}
    assert [got[k].copy_of for k in (1, 2, 3)] == [1, 2, 1]
    blocks = {r.doc_id: bytes(r.data) for r in token_blocks.token_blocks(docs).collect()}
    assert blocks[1] == blocks[3] != blocks[2]
    near = {r.doc_id: r.kept for r in simhash_dedup.near_duplicates(docs).collect()}
    assert near == {1: True, 2: True, 3: False}
    lines = {r.doc_id: r.kept for r in line_dedup.line_duplicates(docs).collect()}
    assert lines == {1: True, 2: True, 3: False}


# --- 3


def test_quality_equals_sql(spark):
    docs, rows = tricky(spark, ["### $$ @@ ## {{}}", "SHOUT " * 30, "go go go go on", "a b c d\n" * 9, "9 8 7 6 55", "one. " * 3000])
    same_as_sql(quality.ledger(docs), quality.SQL, documents=docs)
    same_as_sql(quality.ablation(quality.ledger(docs)), quality.ABLATION_SQL, documents=docs)
    rejected = {r.doc_id for r in quality.ledger(docs).where("rejected_v1").collect()}
    kept = quality.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == quality.ledger(docs).where("not rejected_v1").count()
    assert 0 not in rejected and 4 in rejected and 3 in rejected
    assert quality.ledger(empty(spark)).collect() == [] and quality.accepted(empty(spark)).collect() == []


def test_new_policies_need_the_ledger_only(spark, tmp_path):
    docs, _ = tricky(spark, ["### $$ @@ ## {{}}", "SHOUT " * 30, "one two three four five six"])
    docs.write.parquet(f"{tmp_path}/docs")
    stored = quality.ledger(spark.read.parquet(f"{tmp_path}/docs"))
    shutil.rmtree(f"{tmp_path}/docs")
    new = {3: ["no_sentence_end"], 4: ["few_words", "capitals"]}
    rows = quality.judged(stored, new).collect()
    failing = lambda r, *names: any(r.bits >> [n for n, _ in quality.RULES].index(x) & 1 for x in names)
    assert any(r.rejected_v3 for r in rows) and any(r.rejected_v4 for r in rows)
    assert all(r.rejected_v3 == failing(r, *new[3]) and r.rejected_v4 == failing(r, *new[4]) for r in rows)
    counts = {(r.policy, r.rule): (r.failing, r.alone, r.rejected) for r in quality.ablation(stored, new).collect()}
    for v, names in new.items():
        for x in names:
            others = [y for y in names if y != x]
            assert counts[v, x] == (sum(failing(r, x) for r in rows), sum(failing(r, x) and not failing(r, *others) for r in rows), sum(failing(r, *names) for r in rows))


# --- 4


def test_spans_equal_sql(spark):
    rng = random.Random(9)
    items = [prose(rng, 20), prose(rng, 13), prose(rng, 12), None, "", prose(rng, 40)]
    items.append(items[0])
    extra = ["start " + items[0] + " end", items[1], " ".join(items[5].split()[3:30]) + " then " + " ".join(items[5].split()[10:]), items[0] + " " + items[0], items[2]]
    docs, _ = tricky(spark, extra)
    bench = spark.createDataFrame([(k, t, "extra") for k, t in enumerate(items)] + [(None, items[5], "extra"), (-1, items[5], "extra"), (-7, items[0], "extra")], "item_id long, text string, doc_id string")
    same_as_sql(span_hashes.spans(docs, bench), span_hashes.SQL, documents=docs, benchmark=bench)
    same_as_sql(span_hashes.spans(docs, bench, broadcast_words=30), span_hashes.SQL, documents=docs, benchmark=bench)
    assert span_hashes.spans(empty(spark), bench).collect() == [] and span_hashes.spans(docs, bench.limit(0)).where("n_spans > 0").count() == 0


def test_span_equality_and_extensions():
    rng = np.random.default_rng(3)
    x, y = (rng.integers(1, 4, 60).astype(np.uint64) for _ in range(2))
    a, b = span_hashes.Prefixes(x), span_hashes.Prefixes(y)
    i, j = (z.ravel() for z in np.meshgrid(np.arange(60), np.arange(60)))
    limit = np.minimum(60 - i, 60 - j)
    got = span_hashes.common_extension(a, i, b, j, limit)
    for p, q, n, m in zip(i.tolist(), j.tolist(), got.tolist(), limit.tolist()):
        want = next((t for t in range(m) if x[p + t] != y[q + t]), m)
        assert n == want


# --- 5 and 6


def test_token_blocks_round_trip(spark):
    import tiktoken

    docs, rows = tricky(spark)
    bpe = tiktoken.Encoding("file", pat_str=vocabulary.PATTERN, mergeable_ranks=vocabulary.ranks(), special_tokens={})
    got = token_blocks.token_blocks(docs).collect()
    assert len(got) == len(rows)
    for r, t in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens)), [x[1] for x in sorted(rows, key=lambda x: (x[0] is None, x[0], len(x[1] or "")))]):
        want = bpe.encode_ordinary(t or "")
        assert r.n_tokens == len(want) and token_blocks.decode(bytes(r.data), r.block_starts).tolist() == want
    assert token_blocks.token_blocks(empty(spark)).collect() == []


def test_blocks_of_any_ids():
    rng = np.random.default_rng(4)
    lengths = np.array([0, 1, 127, 128, 129, 1000, 0])
    ids = np.where(rng.random(lengths.sum()) < 0.05, rng.integers(0, 2**32, lengths.sum()), rng.integers(100, 200, lengths.sum()))
    blob, size, starts, n = token_blocks.encode(ids, lengths)
    raw, at, s = blob.tobytes(), 0, 0
    for k, length in enumerate(lengths):
        assert token_blocks.decode(raw[at : at + size[k]], starts[s : s + n[k]].tolist()).tolist() == ids[lengths[:k].sum() :][:length].tolist()
        at, s = at + size[k], s + n[k]
    assert len(raw) < 4 * lengths.sum()
    assert token_blocks.decode(*(lambda b: (b[0].tobytes(), b[2].tolist()))(token_blocks.encode(np.full(128, 7), np.array([128])))).tolist() == [7] * 128


def test_piece_counts_equal_greedy(spark):
    tokens = set(vocabulary.ranks())
    longest = max(map(len, tokens))
    docs, rows = tricky(spark)

    def count(word):
        n, at = 0, 0
        while at < len(word):
            at = next(e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in tokens)
            n += 1
        return n

    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_words, r.n_pieces) for r in piece_counts.count_pieces(docs).collect())
    want = sorted((d is None, d or 0, len((t or "").encode()), len((t or "").encode().split()), sum(count(b" " + w) for w in (t or "").encode().split())) for d, t, *_ in rows)
    assert got == want
    assert piece_counts.count_pieces(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        piece_counts.Automaton([b"a", b"ab"])


# --- 7


def brute_lines(rows):
    """(doc_id, line_no) -> (kept, leader) by comparing every pair of lines."""
    docs = {(d is None, d or 0, t): d for d, t, *_ in rows if t is not None}
    lines = []
    for (null, _, t), d in sorted(docs.items(), key=lambda x: x[0][:2]):
        low = t.lower()
        for k, (line, raw) in enumerate(zip(low.split("\n"), t.split("\n"))):
            words = line_dedup.normalise(line.encode())
            lines.append((d, k, words))
    long = [x for x in lines if len(x[2].split()) >= line_dedup.MIN_WORDS]
    texts = sorted({x[2] for x in long})
    prints = {}
    import pyarrow as pa

    for t in texts:
        p = next(vectext.pieces(pa.array([t])))
        prints[t] = int(vectext.simhash(vectext.mix(p.hash, 22), np.zeros(len(p.hash), np.int64), 1)[0])
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= line_dedup.RADIUS and line_dedup.similar(a, b):
                parent[find(b)] = find(a)
    lead, out = {}, {}
    for d, k, t in lines:
        if len(t.split()) < line_dedup.MIN_WORDS:
            out[d, k] = (True, (d, k))
        else:
            first = lead.setdefault(find(t), (d, k))
            out[d, k] = (first == (d, k), first)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(10)
    lines = [prose(rng, 40) for _ in range(12)]
    variants = []
    for line in lines:
        w = line.split()
        w[3] += "x"
        variants.append(" ".join(w))
    extra = ["\n".join(rng.choices(lines + variants + ["", "short one", prose(rng, 8)], k=rng.randint(1, 9))) for _ in range(25)] + [lines[0].upper() + "\n", "\n\n"]
    docs, rows = tricky(spark, extra)
    want = brute_lines(rows)
    got = {(r.doc_id, r.line_no): (r.kept, (r.leader_doc_id, r.leader_line_no)) for r in line_dedup.line_duplicates(docs).collect()}
    assert got == want
    cleaned = line_dedup.clean(docs)
    assert cleaned.columns == docs.columns
    held = {r.doc_id: r for r in cleaned.where("doc_id is not null").collect()}
    for d, t, *_ in rows:
        if d is None:
            continue
        left = None if t is None else [x for k, x in enumerate(t.split("\n")) if want[d, k][0]]
        assert (d not in held) if left == [] else held[d].text == (None if left is None else "\n".join(left)), d
        if d in held and t is not None:
            assert held[d].n_chars == len(held[d].text)
    assert line_dedup.line_duplicates(empty(spark)).collect() == [] and line_dedup.clean(empty(spark)).collect() == []


def test_similar_lines_are_linked_whatever_their_words(spark):
    rng = random.Random(21)
    lines = []
    for n in (8, 10, 14, 20, 60):
        for _ in range(40):
            w = prose(rng, n).split()
            lines.append(" ".join(w))
            for _ in range(max(1, n // 10)):
                w[rng.randrange(n)] = rng.choice(["vexing", "quartz", "jolly"])
            lines.append(" ".join(w))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id long, text string").repartition(3)
    lead = {r.doc_id: r.leader_doc_id for r in line_dedup.line_duplicates(docs).collect()}
    pairs = [(i, j) for j in range(len(lines)) for i in range(j) if line_dedup.similar(lines[i], lines[j])]
    assert len(pairs) >= 190 and sum(lead[i] == lead[j] for i, j in pairs) >= 0.9 * len(pairs)
    assert all(lead[k] == k or any(line_dedup.similar(lines[k], lines[j]) for j in range(len(lines)) if j != k) for k in lead)


def test_short_lines_that_repeat_go(spark):
    docs = spark.createDataFrame([(1, "All rights reserved.\n\n漢字だけの行です"), (2, "all rights reserved\n\n\n漢字だけの行です"), (3, "No."), (4, "no"), (5, "...\n...")], "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.kept, r.leader_doc_id) for r in line_dedup.line_duplicates(docs).collect()}
    assert [k for k, v in sorted(got.items()) if not v[0]] == [(2, 0), (2, 3), (4, 0)]
    assert got[2, 0][1] == got[2, 3][1] == 1 and got[4, 0][1] == 3


def test_edit_distance():
    rng = random.Random(11)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(400):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(2))
        for limit in range(8):
            assert line_dedup.levenshtein_within(a, b, limit) == (slow(a, b) <= limit)


def test_pairs_measured_at_once_equal_plain_edit_distance():
    rng = random.Random(12)

    def slow(a, b):
        row = np.arange(len(b) + 1)
        for x in a:  # the least of what comes from above, then what comes from the left
            new = np.minimum(row + 1, np.append(row[0] + 1, row[:-1] + np.array([x != y for y in b], int)))
            row = np.minimum.accumulate(new - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
        return int(row[-1])

    one, two = ["", "a", "abcd", "abcd"], ["", "", "abcd", "abce"]
    for _ in range(400):
        a = rng.choices("abcdeé漢𝒳 ", k=rng.choice((rng.randint(1, 70), rng.randint(60, 300))))
        b = list(a)
        for _ in range(int(len(a) * rng.uniform(0, 0.7))):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = rng.choice(("", "a", "b", "ż"))
        one.append("".join(a))
        two.append("".join(b))
    far = [slow(a, b) for a, b in zip(one, two)]
    assert len({len(a) for a in one}) > 100
    for similarity in (1.0, 0.98, 0.8, 0.5):
        want = [d <= int(max(len(a), len(b)) * (1 - similarity) + 1e-9) for a, b, d in zip(one, two, far)]
        assert 2 < sum(want) < len(want)
        for likely in (True, False):
            assert line_dedup.all_similar(one, two, similarity, likely).tolist() == want
    assert line_dedup.all_similar([], []).tolist() == []


# --- 8


def test_packing_equals_a_plain_loop(spark):
    docs, rows = tricky(spark, ["y" * 70_000])
    for shard_tokens in (1 << 22, 4000):
        got = packing.packed(docs, capacity=500, shard_tokens=shard_tokens).collect()
        tokens = lambda t: max(1, round(len(t) / 4)) if t else 0
        assert sum(r.n_tokens for r in got) == sum(tokens(t) for _, t, *_ in rows)
        shards: dict = {}
        for r in got:
            shards.setdefault(r.shard, []).append(r)
        assert len(shards) > 1 or shard_tokens > 4000
        for held in shards.values():
            held.sort(key=lambda r: (-r.n_tokens, r.doc_id is None, r.doc_id or 0, r.piece))
            n = -(-sum(r.n_tokens for r in held) // 500)
            room, cost, want = [500] * n, [0] * n, []
            for r in held:
                fits = [k for k in range(len(room)) if room[k] >= r.n_tokens]
                if not fits:
                    room.append(500)
                    cost.append(0)
                    fits = [len(room) - 1]
                k = min(fits, key=lambda k: (cost[k], k))
                room[k] -= r.n_tokens
                cost[k] += packing.LINEAR * r.n_tokens + packing.QUADRATIC * r.n_tokens**2
                want.append(k)
            assert sorted((r.n_tokens, r.sequence) for r in held) == sorted((r.n_tokens, k) for r, k in zip(held, want))
            assert all(r.sequence_tokens == 500 - room[r.sequence] and r.sequence_cost == cost[r.sequence] for r in held)
    assert packing.packed(empty(spark)).collect() == []


def test_packing_spreads_rows_without_doc_id(spark):
    docs = spark.range(3000).selectExpr("cast(null as long) as doc_id", "repeat('a', 400) as text")
    got = packing.packed(docs, capacity=1000, shard_tokens=10_000).groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()
    assert sum(r.n for r in got) == 300_000 and len(got) >= 25 and max(r.n for r in got) < 30_000
    got = packing.packed(spark.range(140_000).selectExpr("7L as doc_id", "'abcd' as text"), shard_tokens=20_000).groupBy("shard").count().collect()
    assert sum(r["count"] for r in got) == 140_000 and len(got) == 7


# --- 9


def test_votes(spark):
    rng = random.Random(12)
    good, bad = ["river", "stone", "harvest", "window", "garden"], ["zugga", "hatred", "vermin", "filthy", "worthless"]
    rows, labels = [], []
    for k in range(160):
        toxic = int(k % 4 == 0)
        rows.append((k, prose(rng, 40) + " " + " ".join(rng.choices(bad if toxic else good, k=8))))
        if k < 120:
            labels.append((k, 1 - toxic, toxic, "extra"))
    labels += [labels[0], (None, 1, 1, "x"), (9999, 1, 0, "x"), (5, None, 1, "x")]
    rows += [(500, None), (501, ""), (None, rows[0][1]), rows[7]]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, quality string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = neighbour_votes.classify(docs, lab).collect()
    assert len(got) == len(rows)
    held_out = [r for r in got if r.doc_id is not None and 120 <= r.doc_id < 160]
    assert np.mean([r.toxic == int(r.doc_id % 4 == 0) for r in held_out]) >= 0.95
    share = next(r.quality_vote for r in got if r.doc_id == 500)
    assert share == pytest.approx(np.mean([x[1] for x in labels[:120]] + [1]))
    none = neighbour_votes.classify(docs, lab.limit(0)).collect()
    assert len(none) == len(rows) and all(r.quality is None and r.toxic_vote is None for r in none)
    assert neighbour_votes.classify(docs.limit(0), lab).collect() == []
    space, _ = neighbour_votes.fit(docs, lab)
    import pyarrow as pa

    v = space.vectors_of(pa.array([r[1] for r in rows[:10]]))
    votes, _ = space.votes(v, np.arange(10), 15)
    for k in range(10):  # every cosine, one by one
        sims = np.array([float(v[k] @ x) if d != k else -1 for x, d in zip(space.vectors, space.doc_ids)])
        near = np.argsort(-sims)[:15]
        w = np.maximum(sims[near], 0) * space.stands_for[near]
        assert votes[k] == pytest.approx((w[:, None] * space.labels[near]).sum(axis=0) / w.sum(), abs=1e-4)


# --- 10


def test_bk_tree_finds_all():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 2**13, 700).astype(np.uint64)
    tree = simhash_dedup.BKTree(values)
    asked = rng.integers(0, 2**13, 200).astype(np.uint64)
    for radius in (0, 1, 3):
        q, v = tree.within(asked, radius)
        want = {(k, int(x)) for k, a in enumerate(asked) for x in set(values.tolist()) if int(a ^ np.uint64(x)).bit_count() <= radius}
        assert set(zip(q.tolist(), v.tolist())) == want and len(q) == len(want)
    assert len(simhash_dedup.BKTree(values[:0]).within(asked, 2)[0]) == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(13)
    extra = []
    for _ in range(12):
        words = prose(rng, 200).split()
        for _ in range(rng.randint(1, 4)):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(200)] = rng.choice(["alpha", "bravo", "candle"])
            extra.append(" ".join(copy))
    docs, rows = tricky(spark, extra)
    prints = [(r.doc_id, r.sig, r.h1, r.h2) for r in simhash_dedup.fingerprints(docs).distinct().collect()]
    m = (1 << 64) - 1
    parent = list(range(len(prints)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (_, _, a1, a2) in enumerate(prints):
        for j, (_, _, b1, b2) in enumerate(prints[:i]):
            if a1 is None or b1 is None:
                continue
            near = ((a1 ^ b1) & m).bit_count()
            if near <= simhash_dedup.RADIUS and near + ((a2 ^ b2) & m).bit_count() <= simhash_dedup.BOTH:
                parent[find(i)] = find(j)
    groups: dict = {}
    for k in range(len(prints)):
        groups.setdefault(find(k), []).append(prints[k])
    want = []
    for held in groups.values():
        held.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        want += [(d, held[0][0], (d, sig) == held[0][:2]) for d, sig, *_ in held]
    key = lambda x: repr(x)
    got = [(r.doc_id, r.group_id, r.kept) for r in simhash_dedup.near_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    by_id = {d: (g, kept) for d, g, kept in got if d is not None}
    assert by_id[0] == (0, True) and by_id[1] == (0, False) and by_id[2] == (0, False) and by_id[3][1] and by_id[4][1]
    out = simhash_dedup.dedup(docs)
    assert out.columns == docs.columns and out.where("doc_id = 0").count() == 1 and out.where("doc_id = 2").count() == 0 and out.where("doc_id = 9").count() == 1
    assert out.count() == sum(kept for *_, kept in want)
    assert simhash_dedup.near_duplicates(empty(spark)).collect() == [] and simhash_dedup.dedup(empty(spark)).collect() == []


def test_either_half_may_hold_the_differing_bits(spark):
    flip = lambda h, bits: h ^ sum(1 << b for b in bits)
    h1, h2 = 0x123456789ABCDEF, 0x7EDCBA987654321
    few, many = range(0, 60, 13), range(0, 60, 4)  # 5 and 15 bits
    for a, b, near in ((few, many, 1), (many, few, 1), (many, many, 0)):
        prints = spark.createDataFrame([(h1, h2), (flip(h1, a), flip(h2, b))], "h1 long, h2 long")
        assert simhash_dedup.near_edges(prints).distinct().count() == near


@pytest.mark.parametrize("limit", [10_000, 0])
def test_connected_groups(spark, limit):
    rng = random.Random(14)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)] + [(200, 200), (7, 7)]
    parent = list(range(300))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long"), limit).collect()}
    want = {k: find(k) for a, b in edges for k in (a, b)}
    assert {k: v for k, v in got.items()} == {k: v for k, v in want.items() if k in got} and all(v == k for k, v in want.items() if k not in got)
    assert connected(spark.createDataFrame([], "a long, b long"), limit).collect() == []


def test_pairs_within_a_radius():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2**63, 50).astype(np.uint64)
    got = {(int(i), int(j)) for x, y in hamming.close_pairs(a, a, 26, 64) for i, j in zip(x, y)}
    assert got == {(i, j) for i in range(50) for j in range(50) if int(a[i] ^ a[j]).bit_count() <= 26}


# --- the pipeline


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is optional")
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, rows = tricky(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = set(docs.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, str(tmp_path))
        assert set(out.columns) == columns, name
        path = f"{tmp_path}/{name.replace(' ', '_')}"
        out.write.parquet(path)
        held = spark.read.parquet(path)
    packed = corpus_pipeline.STAGES[-1][1](spark, held, str(tmp_path))
    tokens = held.agg(F.sum(mixing.n_tokens(F.col("text")))).first()[0]
    assert packed.agg(F.sum("n_tokens")).first()[0] == tokens
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(corpus_pipeline.run(spark, str(tmp_path))) == key(packed)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
