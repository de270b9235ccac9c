"""Sharding: every row placed once, near-equal bytes, gapless slots, hot texts split."""

import zlib

from factloom.llm import shards


def placed(df, **options):
    return shards.shard(df, **options).select("row.doc_id", "row.text", "size", "text_crc32", "shard", "slot").collect()


def check(rows, got, count):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == sorted((d is None, d or 0, t or "") for d, t in rows)
    sums, slots = [0] * count, [[] for _ in range(count)]
    for r in got:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    return sums


def test_near_equal_bytes_with_a_hot_text(spark):
    rows = [(i, "hot text of a third of all rows" if i % 3 == 0 else f"é{i} " * (i % 90)) for i in range(6000)]
    df = spark.createDataFrame([(a, b, 1, "s") for a, b in rows], "doc_id long, text string, shard int, _hash string").repartition(8)
    got = placed(df)
    sums = check(rows, got, 40)
    assert max(sums) - min(sums) <= 2 * max(r.size for r in got)
    assert len({r.shard for r in got if r.text and r.text.startswith("hot")}) > 1
    # equal texts lie together: all but those at a boundary are in one shard
    held = {}
    for r in got:
        held.setdefault(r.text, set()).add(r.shard)
    assert sum(len(s) > 1 for s in held.values()) < 40


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (None, "x"), (None, None), (2, ""), (2, ""), (-9, "y" * 100000), (1 << 62, "z"), (-(1 << 62), "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, placed(df), 40)
    check(rows, placed(df, shards=1), 1)
    same = [(7, "same")] * 50
    check(same, placed(spark.createDataFrame(same, "doc_id long, text string"), shards=4), 4)
    assert placed(df.where("false")) == []


def test_a_very_hot_text_is_refined_by_id(spark, monkeypatch):
    monkeypatch.setattr(shards, "MOST_ROWS", 20)
    rows = [(i * i, "hot") for i in range(3000)]
    sums = check(rows, placed(spark.createDataFrame(rows, "doc_id long, text string"), shards=7), 7)
    assert max(sums) - min(sums) <= 2 * 19


def test_equal_texts_are_split_only_where_no_edge_is_near(spark):
    rows = [(i, f"é{i // 2} " * (1 + i // 2 % 90)) for i in range(4000)] + [(5000 + i, "some copies") for i in range(20)]
    got = placed(spark.createDataFrame(rows, "doc_id long, text string"), shards=13)
    sums = check(rows, got, 13)
    share = sum(sums) / 13
    # every pair and the group of 20 (under a fiftieth of a shard) lie in one shard each
    held = {}
    for r in got:
        held.setdefault(r.text, set()).add(r.shard)
    assert max(map(len, held.values())) == 1
    assert max(abs(s - share) for s in sums) <= 2 * max(shards.GROUP_TOLERANCE * share, max(r.size for r in got))


def test_large_pairs_do_not_empty_a_shard(spark):
    rows = [(i, f"{i // 2}" + "x" * 10000) for i in range(12)]
    sums = check(rows, placed(spark.createDataFrame(rows, "doc_id long, text string"), shards=12), 12)
    assert min(sums) > 0 and max(sums) - min(sums) < 100
