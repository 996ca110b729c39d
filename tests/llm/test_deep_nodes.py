"""Nodes of the path tree that stay large down to the deepest level."""

import random
from itertools import combinations

from treequill.llm import ngram_join


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def sharing(pairs, seed, template=60, own=90):
    """Pairs of near copies, all with a template that by itself makes no two similar."""
    rng = random.Random(seed)
    common = [f"t{i}" for i in range(template)]
    rows = []
    for i in range(pairs):
        text = [f"w{rng.randrange(10**9)}" for _ in range(own)]
        edited = [*text]
        edited[rng.randrange(10, own - 10)] = "edited"
        rows += [(2 * i, " ".join(common + text)), (2 * i + 1, " ".join(common + edited))]
    return rows


def test_every_pair_of_a_large_deepest_node_is_compared(spark, monkeypatch):
    def one_node(runs, depth, threshold):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                cls = batch.column(batch.schema.get_field_index("cls"))
                yield pa.RecordBatch.from_arrays([pa.array([1] * len(cls), pa.int64()), cls], names=["node", "cls"])

        return run

    monkeypatch.setattr(ngram_join, "_root_rows", one_node)
    monkeypatch.setattr(ngram_join, "BUCKET", 8)
    monkeypatch.setattr(ngram_join, "MOST_DEPTH", ngram_join.START_DEPTH)
    rows = sharing(100, 3)
    sets = {i: shingles(t) for i, t in rows}
    links = {i: 0 for i in sets}
    for a, b in combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
    assert set(links.values()) == {1}
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in out} == links
    assert {r.doc_id: r.class_id for r in out} == {i: i - i % 2 for i in sets}


def test_deeper_nodes_take_more_runs():
    assert ngram_join.deep_runs_for(0.999, depth=8) > ngram_join.runs_for(0.999)
    assert ngram_join.deep_runs_for(0.9, depth=8) < ngram_join.deep_runs_for(0.999, depth=8)


def test_recall_in_the_deepest_nodes(spark, monkeypatch):
    """Near copies just over the threshold, in families that share a template, where every level is split down to the last."""
    levels = []
    split = ngram_join._split_rows
    monkeypatch.setattr(ngram_join, "_split_rows", lambda threshold: levels.append(1) or split(threshold))
    monkeypatch.setattr(ngram_join, "BUCKET", 2)
    rng = random.Random(11)
    rows = []
    for family in range(4):
        common = [f"f{family}t{i}" for i in range(220)]
        for _ in range(60):
            text = [f"w{rng.randrange(10**9)}" for _ in range(90)]
            edited = [*text]
            for at in rng.sample(range(5, 85, 8), 6):
                edited[at] = f"e{rng.randrange(10**9)}"
            rows += [(len(rows), " ".join(common + text)), (len(rows) + 1, " ".join(common + edited))]
    sets = {i: shingles(t) for i, t in rows}
    links = {frozenset(p) for p in combinations(sets, 2) if 5 * len(sets[p[0]] & sets[p[1]]) >= 4 * len(sets[p[0]] | sets[p[1]])}
    assert len(links) == 240
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(levels) == ngram_join.MOST_DEPTH - ngram_join.START_DEPTH
    assert all(r.n_links == int(any(r.doc_id in p for p in links)) or r.n_links == 0 for r in out)
    assert sum(r.n_links for r in out) / 2 >= 0.9 * len(links)


def test_tiles_of_signatures_cover_all_pairs(spark, monkeypatch):
    """A node far over the side of a tile, whose classes meet in the tiles of a bucket only."""
    monkeypatch.setattr(ngram_join, "SIDE", 8)
    rows = sharing(40, 5, template=200)
    out = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), tile=8).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in out} == {i: (i - i % 2, 1) for i, _ in rows}
