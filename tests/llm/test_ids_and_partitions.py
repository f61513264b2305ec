"""Ids of other types, sidecars that are really read, and verdicts that do not depend on how rows are dealt out."""

import pytest
from pyspark.sql import functions as F

from mendcast.llm.common import vocabulary


def test_exact_dedup_with_text_ids(spark):
    from mendcast.llm.exact_dedup import exact_dedup

    rows = [("b", "x  y"), ("a", "x y"), (None, "x\ty"), ("c", "z"), (None, None), ("d", ""), ("a", "x y")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id string, text string"), capacity=2).collect()
    assert sorted((r.doc_id or "", r.keep_id, r.group_size) for r in got) == [
        ("", "a", 4), ("", "d", 2), ("a", "a", 4), ("a", "a", 4), ("b", "a", 4), ("c", "c", 1), ("d", "d", 2)]
    assert sorted(r.doc_id for r in got if r.kept) == ["a", "c", "d"]


def test_copies_come_from_the_index(spark, monkeypatch):
    """Entries that the index does not call shared are not compared; two texts under one hash stay apart."""
    from mendcast.llm import exact_dedup as ed

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "a", "b", "b", "c"])], "doc_id long, text string")
    whole = ed.build_index
    monkeypatch.setattr(ed, "build_index", lambda entries, capacity: whole(entries, capacity).withColumn("_n", F.lit(1)))
    assert all(r.group_size == 1 and r.kept for r in ed.exact_dedup(docs).collect())
    monkeypatch.undo()
    one = spark.createDataFrame([(0, 5, 0, 5)], "bucket long, local_depth int, _h long, _n long")
    real = F.xxhash64
    monkeypatch.setattr(ed.F, "xxhash64", lambda *c: F.lit(0).cast("long"))
    found = {(r.keep_id, r.group_size) for r in ed.chains(docs, one, "doc_id", "text").collect()}
    monkeypatch.setattr(ed.F, "xxhash64", real)
    assert found == {(0, 2), (2, 2)}


def test_archives_with_text_ids(spark):
    from mendcast.llm.warc import archive_round_trip

    rows = [("p>1\n", "u", "same"), ("", "u", "same"), (None, "u", "same"), ("z é%", "u", "same"), ("q", None, None)]
    got = archive_round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {
        ("z é%", "response", None), ("p>1\n", "revisit", "z é%"), ("", "revisit", "z é%"), (None, "revisit", "z é%"), ("q", "response", None)}


def test_records_are_read_through_the_sidecars(spark, tmp_path):
    from mendcast.llm import warc

    pages = spark.createDataFrame([(i, "u", f"page {i} " * 30) for i in range(40)], "page_id long, url string, html string").repartition(2)
    rows = warc.with_revisits(pages, "page_id", "html", "url", 0)
    archives = warc.write_archives(rows, f"file://{tmp_path}/a")
    normal = warc.normalise_archives(archives, f"file://{tmp_path}/a", f"file://{tmp_path}/b")
    assert normal.columns == ["file"]
    index = warc.read_sidecars(normal, f"file://{tmp_path}/b")
    assert sorted(int(r._id) for r in warc.read_records(index, f"file://{tmp_path}/b").collect()) == list(range(40))
    side = next((tmp_path / "b").glob("*.idx"))
    lines = side.read_text().splitlines()
    side.write_text("\n".join(lines[1:]) + "\n")
    short = warc.read_sidecars(normal, f"file://{tmp_path}/b")
    assert warc.read_records(short, f"file://{tmp_path}/b").count() == 39
    side.write_text(lines[0].replace('"offset": ', '"offset": 7') + "\n")
    broken = warc.read_sidecars(normal, f"file://{tmp_path}/b")
    with pytest.raises(Exception):
        warc.read_records(broken, f"file://{tmp_path}/b").collect()


def test_fertility_does_not_depend_on_partitions(spark):
    import random

    from mendcast.llm.fertility import fertility_quality

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gammaray", "de", "qx", "zzzzqqq"]) + str(rng.randrange(99)) for _ in range(rng.randint(50, 120))), "aa" if i % 3 else "bb")
            for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    some = [sorted(map(tuple, fertility_quality(docs.repartition(n, F.rand(n)), vocabulary("piece_bpe_32k.model"), width=1.0).collect())) for n in (1, 3, 7)]
    assert some[0] == some[1] == some[2] and 0 < sum(r[8] is None for r in some[0]) < 400


def test_large_facts_are_salted_not_broadcast(spark, monkeypatch):
    from mendcast.layout import materialise
    from mendcast.llm import common

    rows = spark.range(1000).select(F.col("id").alias("_id"), (F.col("id") % 7).alias("k"))
    facts = materialise(rows.where("k < 5").groupBy("k").agg(F.count("*").alias("_n"), F.max("_id").alias("m")))
    small = common.attach_small(rows, facts, ["k"], "_id", "left")
    monkeypatch.setattr(common, "SMALL", 2)
    large = common.attach_small(rows, facts, ["k"], "_id", "left")
    pick = ["_id", "k", "_n", "m"]
    assert sorted(map(str, small.select(*pick).collect())) == sorted(map(str, large.select(*pick).collect()))
    assert common.attach_small(rows, facts, ["k"], "_id").count() == rows.where("k < 5").count()


def test_near_copies_just_below_the_threshold(spark, monkeypatch):
    """A group of near copies of which a third lies just below the threshold to the centre, some of them linked to each other."""
    import itertools
    import random

    from mendcast.llm import jaccard_join as jj

    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]

    def edited(words, n):
        words = list(words)
        for i in rng.sample(range(0, 150, 5), n):
            words[i] = f"e{rng.randrange(60)}"
        return words

    texts = [base] + [edited(base, rng.randint(0, 4)) for _ in range(60)] + [edited(base, rng.randint(5, 9)) for _ in range(40)]
    for _ in range(12):
        far = edited(base, 7)
        texts += [far, edited(far, 1), far[:-30]]
    texts += [base[:110], base[:105], base[40:], ["z"] + base[:112]]
    texts = [" ".join(t) for t in texts]
    sets = [{tuple(t.split()[i: i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rounds = {}
    for n in (0, 2):  # without star rounds every link comes from the questions
        monkeypatch.setattr(jj, "STAR_ROUNDS", n)
        rounds[n] = {r.doc_id: r.component_id for r in jj.near_duplicate_classes(docs).collect()}
        assert rounds[n] == {i: root(i) for i in range(len(texts))}
    assert len(set(rounds[2].values())) > 20
