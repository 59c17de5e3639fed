"""Archives, classifiers and the pipeline."""

import gzip
import hashlib
import io
import zlib

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evograph.llm import quality_knn, quality_rules, queries, toxicity, warc
from evograph.llm.common import shared_dir

SF = "/root/testdata/sf0.001"


def test_archives_sql(spark):
    assert oracle.check(queries.op2_warc(spark, SF), queries.ORACLE_SQL["op2_warc"], SF) == 50


def test_archives_odd_rows(spark):
    long, other = "x" * 1500 + "ü", "y" * 2000
    rows = [(1, "u", long), (7, "u\r\nv", long), (7, None, long), (None, "w", long), (2, None, None), (3, "", ""), (4, "a", "short"), (5, "a", "short"), (None, "n", other), (None, "n", other), (6, "r", "a\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("revisit", F.lit(1)).withColumn("payload", F.lit("clash"))
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()]
    assert len(got) == len(rows)
    assert sorted(x for x in got if x[1] == 1502 and x[0] is not None) == [(1, 1502, "revisit", 7), (7, 1502, "response", None), (7, 1502, "response", None)]
    assert (None, 1502, "revisit", 7) in got and got.count((None, 2000, "response", None)) == 2
    assert all(x[2] == "response" for x in got if x[1] < 1000)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_normaliser_and_random_access(spark, tmp_path):
    whole = [warc.record_of(i, f"http://x/{i}", b"p%d" % i * (i + 1), False, None) for i in range(50)]
    source, target = f"file://{tmp_path}/a.warc.gz", f"file://{tmp_path}/b.warc.gz"
    with gzip.open(f"{tmp_path}/a.warc.gz", "wb") as f:
        for r in whole:
            f.write(r.dump())
    assert warc.normalise_file(source, target) == 50
    import json

    index = [json.loads(x) for x in open(f"{tmp_path}/b.warc.gz.idx")]
    assert sum(e["length"] for e in index) == (tmp_path / "b.warc.gz").stat().st_size
    for i in (49, 0, 17):
        r = warc.read_record(target, index[i]["offset"], index[i]["length"])
        assert r.block == whole[i].block and r.fields == whole[i].fields
    assert b"".join(warc.inflate(io.BytesIO((tmp_path / "b.warc.gz").read_bytes()))) == b"".join(r.dump() for r in whole)
    with pytest.raises(ValueError):
        list(warc.records(iter([whole[1].dump()[:-9]])))


def test_payloads_survive(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    folder = f"{shared_dir(spark)}/t"
    archives = warc.normalise(warc.write(pages, folder), folder)
    got = {r.page_id: hashlib.sha1(r.payload).hexdigest() for r in warc.read(archives, payloads=True).collect() if r.payload is not None}
    want = {r.page_id: hashlib.sha1((r.html or "").encode()).hexdigest() for r in pages.collect()}
    assert all(want[k] == v for k, v in got.items()) and got


def test_every_cut_is_an_error(spark, tmp_path):
    """A stream cut at each flush point, before its trailer, or between members and records: no record is lost in silence."""
    whole = [warc.record_of(i, f"http://x/{i}", b"p%d" % i * (i + 1), False, None) for i in range(40)]
    z, data, ends = zlib.compressobj(6, wbits=31), b"", []
    for r in whole:
        data += z.compress(r.dump()) + z.flush(zlib.Z_FULL_FLUSH)
        ends.append(len(data))
    data += z.flush()
    assert len(list(warc.records(warc.inflate(io.BytesIO(data))))) == 40
    for end in [*ends, 1, 5, len(data) - 1, len(data) - 4, len(data) - 8]:
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(warc.inflate(io.BytesIO(data[:end]))))
    # Cut between members every part is whole by itself: there the manifest's number tells.
    (tmp_path / "whole").mkdir()
    members = [gzip.compress(r.dump()) for r in whole]
    (tmp_path / "whole" / "a.warc.gz").write_bytes(b"".join(members[:20]))
    for said, good in ((40, False), (20, True), (19, False)):
        manifest = spark.createDataFrame([(f"file://{tmp_path}/whole/a.warc.gz", said)], warc._MANIFEST)
        if good:
            assert warc.read(warc.normalise(manifest, f"file://{tmp_path}")).count() == 20
        else:
            with pytest.raises(Exception, match="its manifest says"):
                warc.normalise(manifest, f"file://{tmp_path}")


LABELS = "doc_id long, toxic int, quality int"


def test_chain_finds_words_and_learns_out_of_fold():
    rng = np.random.default_rng(0)
    x = (rng.random((800, 6)) < 0.2).astype(float)
    y = np.column_stack([x[:, 0], x[:, 1], np.maximum(x[:, 0], x[:, 1])])
    chain = toxicity.fit_chain(x, y, np.arange(800) % 5, {bytes([97 + i]): i for i in range(6)}, ["a", "b", "toxic"])
    p = chain.predict(x)
    assert p.shape == (800, 3) and ((p[:, 2] >= chain.threshold) == (y[:, 2] > 0)).mean() > 0.99
    assert len(chain.weights[2]) == 6 + 2 + 1


def test_each_link_is_the_optimum_on_out_of_fold_probabilities():
    """Brute force of the fit: the gradient of each link's penalised likelihood is zero, on inputs made fold by fold."""
    rng = np.random.default_rng(1)
    x = (rng.random((300, 5)) < 0.3).astype(float)
    y = np.column_stack([x[:, 0] * (rng.random(300) < 0.8), np.maximum(x[:, 1], x[:, 2] * (rng.random(300) < 0.5)), np.maximum(x[:, 0], x[:, 1])])
    fold = np.arange(300) % 4
    chain = toxicity.fit_chain(x, y, fold, {bytes([97 + i]): i for i in range(5)}, ["a", "b", "toxic"])

    def gradient(rows, label, w):
        rows = np.hstack([rows, np.ones((len(rows), 1))])
        out = -np.array([0.2] * (len(w) - 1) + [1e-3]) * w
        for r, t in zip(rows, label):
            out += r * (t - 1 / (1 + np.exp(-float(sum(a * b for a, b in zip(r, w))))))
        return np.abs(out).max()

    seen = x
    for k, w in enumerate(chain.weights):
        assert gradient(seen, y[:, k], w) < 1e-4
        column = np.empty(300)
        for f in range(4):
            part = toxicity.logistic(seen[fold != f], y[fold != f, k])
            assert gradient(seen[fold != f], y[fold != f, k], part) < 1e-4
            column[fold == f] = [1 / (1 + np.exp(-(sum(a * b for a, b in zip(r, part)) + part[-1]))) for r in seen[fold == f]]
        seen = np.hstack([seen, column[:, None]])


def test_toxicity_query_is_brute_force(spark):
    """Every document's probabilities and verdict by plain Python from the fitted weights."""
    import re

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op8_toxicity(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = {bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[A-Za-z\x80-\xff]+", (texts[r.doc_id] or "").encode())}
        row = [float(f in found if not f.endswith(b"-") else any(len(w) >= len(f) and w.startswith(f[:-1]) for w in found)) for f in chain.words]
        for name, w in zip(chain.categories, chain.weights):
            z = sum(a * b for a, b in zip(row, w)) + w[-1]
            row.append(1 / (1 + np.exp(-min(30, max(-30, z)))))
            assert abs(r[f"p_{name}"] - row[-1]) < 1e-9
        assert r.toxic == (row[-1] >= chain.threshold)


def test_groups_of_toxic_rows_and_category_columns(spark):
    a, b = [1, 1, 0, 0], [0, 0, 1, 1]
    of = toxicity.grouped(np.array([a, b, a, a, [1, 0, 0, 0], b], float), 2)
    assert of.tolist() == [0, 1, 0, 0, 0, 1]
    assert set(toxicity.grouped(np.zeros((3, 2)), 3).tolist()) == {0}
    rows = [(i, ["a vile clown here", "such useless scum", "good plain words"][i % 3] + f" number{i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 < 2), int(i % 3 == 0), int(i % 3 == 1) if i % 2 else None) for i in range(90)], "doc_id long, toxic int, mockery int, contempt int")
    chain = toxicity.fit(docs, labels, category_cols=("mockery", "contempt"))
    assert chain.categories == ["mockery", "contempt", "toxic"]
    got = toxicity.score(docs, chain).collect()
    assert all((r.p_mockery > 0.5) == (r.doc_id % 3 == 0) and r.toxic == (r.doc_id % 3 < 2) for r in got)
    found = toxicity.score(docs, toxicity.fit(docs, labels, groups=2)).collect()
    assert all(r.toxic == (r.doc_id % 3 < 2) and max(r.p_group1, r.p_group2) > 0.5 for r in found if r.doc_id % 3 < 2)


def test_filtering_stages_on_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", None), (None, "a plain text", "en"), (3, "word " * 30_000, "de"), (4, "twice", "fr"), (4, "twice", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("_label", F.lit(7))
    none = spark.createDataFrame([], LABELS)
    for kept in (toxicity.keep_clean(docs, toxicity.fit(docs, none)), quality_knn.keep_good(docs, quality_knn.fit(docs, none))):
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    assert toxicity.keep_clean(docs.limit(0), toxicity.fit(docs, none)).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = F.pmod(F.col("doc_id"), F.lit(3)) == 0
    chain = toxicity.fit(docs, labels.where(~out))
    got = toxicity.score(docs, chain).select("doc_id", F.col("toxic").alias("said")).join(labels.where(out), "doc_id").collect()
    hit = sum(r.said and r.toxic == 1 for r in got)
    assert hit >= 0.6 * sum(r.toxic for r in got)
    assert sum(r.said and r.toxic == 0 for r in got) <= 0.03 * len(got)


def odd_docs(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "an idiot and a clown", None), (3, "an idiot and a clown", None), (None, "plain text", "en"), (4, "long words here " * 20_000, "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(7))


@pytest.mark.parametrize("labels", [[], [(1, None, None), (None, 1, 1)], [(1, 0, 1), (3, 1, 0)], [(1, 0, 1)]])
def test_odd_rows_and_labels(spark, labels):
    docs, table = odd_docs(spark), spark.createDataFrame(labels, LABELS)
    a = toxicity.score(docs, toxicity.fit(docs, table)).collect()
    b = quality_knn.score(docs, quality_knn.fit(docs, table)).collect()
    assert len(a) == len(b) == 6 and all(0 <= r.p_toxic <= 1 for r in a) and all(0 <= r.score <= 1 for r in b)
    assert len({r.score for r in b if r.doc_id == 3}) == 1 and [r.held_out for r in b if r.doc_id is None] == [True]
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, table)).count() == 0
    assert quality_knn.keep_good(empty, quality_knn.fit(empty, table)).columns == docs.columns


def test_knn_is_brute_force(spark):
    """All documents: the similarity to every voter one by one, and the vote of the nearest with those that are as near as the last."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    space = quality_knn.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op9_quality_knn(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        v = space.vectors(quality_knn.terms(texts[r.doc_id] or "")[None])[0].astype(float)
        sims = [float((v * u).sum()) for u in space.voters.astype(float)]
        last = sorted(sims)[-min(len(sims), quality_knn.NEIGHBOURS)]
        near = [(max(x, 1e-6) ** 4, y) for x, y in zip(sims, space.labels) if x >= last - 5e-6]
        assert abs(r.score - sum(a * y for a, y in near) / sum(a for a, _ in near)) < 1e-2
        assert r.predicted == (r.score >= 0.3)


def test_knn_ties_vote_together():
    unit = np.eye(2, dtype=np.float32)
    space = quality_knn.Space(np.ones(quality_knn.N_TERMS, np.float32), np.zeros((quality_knn.N_TERMS, 2), np.float32), np.repeat(unit[:1], 6, 0), np.array([1, 0, 0, 0, 0, 1.0]))
    space.vectors = lambda counts: np.repeat(unit[:1], len(counts), 0)
    assert space.scores(np.zeros((3, 1)), 2).tolist() == [round(2 / 6, 6)] * 3  # all six are as near as the second


def test_knn_held_out(spark):
    import zlib

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op9_quality_knn(spark, sf).collect()}
    out = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in out)
    assert sum(got[r.doc_id].predicted == r.quality for r in out) >= 0.93 * len(out)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns and kept.count() <= before.count(), name
        assert kept.join(before, "doc_id", "left_anti").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in kept.collect()}
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len(set(texts))
    ran = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in ran.collect()} == {r.doc_id for r in kept.collect()}


def test_hot_labelled_id_is_one_row(spark, monkeypatch):
    """Each labelled id is learned from once, however often it occurs: the sample is bounded in rows, too."""
    texts = [f"some good words number{i} that are an idiot" if i % 3 else f"other plain words number{i}" for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, f"one of many copies {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), i % 2) for i in range(40)], LABELS)
    seen = {}
    monkeypatch.setattr(toxicity, "fit_chain", lambda x, *rest: seen.update(toxicity=len(x)))
    monkeypatch.setattr(quality_rules, "learn", lambda x, bad, fold: seen.update(rules=len(bad)) or [])
    toxicity.fit(docs, labels)
    quality_rules.fit(docs, labels)
    usable = docs.where(~quality_knn.held_out(F.col("doc_id"))).select("doc_id").distinct().count()
    assert seen == {"toxicity": 40, "rules": 40} and len(quality_knn.fit(docs, labels).voters) == usable
    few = quality_knn.fit(docs.where("doc_id = 7"), labels)
    again = quality_knn.fit(docs.where("doc_id = 7").repartition(3, "text"), labels)
    assert np.array_equal(few.voters, again.voters)


def test_pipeline_is_brute_force(spark, tmp_path):
    """run() against exact Jaccard components over what the first two stages keep, with pairs from 0.6 to 0.95."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng, rows = np.random.default_rng(3), []
    for i, r in enumerate(x for x in docs.orderBy("doc_id").collect() if len((x.text or "").split()) >= 100):
        words = r.text.split(" ")
        for k in rng.choice(len(words), int(len(words) * (0.01 + 0.04 * (i % 10) / 10)), replace=False):
            words[k] = words[rng.integers(len(words))]
        rows.append((*r[:1], " ".join(words), *r[2:]))
    more = spark.createDataFrame(rows, docs.schema).withColumn("doc_id", F.col("doc_id") + 100_000)
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        left = stage(spark, left, str(tmp_path)).cache()
    kept = left.select("doc_id", "text").collect()
    sets = []
    for r in kept:
        w = (r.text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    of = list(range(len(sets)))
    near = 0
    for i, a in enumerate(sets):
        for j in range(i):
            share = len(a & sets[j]) / len(a | sets[j])
            near += 0.6 <= share <= 0.95
            if share >= 0.8:
                of = [of[i] if g == of[j] else g for g in of]
    want = {min(r.doc_id for r, g in zip(kept, of, strict=True) if g == name) for name in set(of)}
    assert near >= 20 and len(want) < len(kept)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want
