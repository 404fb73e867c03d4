"""The pipeline against brute force, stage by stage, on invented documents."""

import random

import corpus_pipeline
from lexloom.llm import mixing, packing, quality_rank
from test_minhash import brute, brute_set

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    vocab = ["w%d" % i for i in range(500)]
    docs, labels = [], []
    for i in range(150):
        words = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        poor = rng.random() < 0.2
        if poor:
            words = [w + "##" for w in words]
        copies = [" ".join(words)] + ["\n".join(words)] * rng.choice([0, 0, 1]) + [" ".join(words[:-1] + ["end"])] * rng.choice([0, 0, 1])
        for t in copies:
            docs.append((len(docs), t, "en", rng.choice(["hot", "hot", "hot", "b", "c"]), len(t)))
            labels.append((docs[-1][0], 0 if poor else 1, 0))
    return docs, labels


def test_stages(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mix", "pack"]
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, now, str(tmp_path))
        if name != "pack":
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = now.collect()
    texts, good = {d[0]: d[1] for d in docs}, {i for i, q, _ in labels if q}
    model = quality_rank.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model is not None and {r.doc_id for r in kept["quality"]} == good
    squeezed = {}
    for i in sorted(good, key=lambda i: (-len(texts[i]), i)):
        squeezed.setdefault("".join(texts[i].split()), i)
    assert {r.doc_id for r in kept["exact_dedup"]} == set(squeezed.values())
    classes = brute([(i, texts[i]) for i in sorted(squeezed.values())])
    assert {r.doc_id for r in kept["near_dedup"]} == {i for i, (_, c) in classes.items() if i == c}
    assert sorted(map(tuple, kept["mix"])) == sorted(map(tuple, kept["near_dedup"]))
    assert {r.doc_id for r in kept["pack"]} == {r.doc_id for r in kept["mix"]} and all(brute_set(texts[r.doc_id]) for r in kept["pack"])
    again = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in kept["pack"])


def test_packing_follows_the_schedule(spark, tmp_path):
    rng = random.Random(5)
    # Files by source, as no schedule would have them.
    docs = [(i, " ".join("w%d" % rng.randint(0, 99) for _ in range(rng.randint(5, 60))), "en", "a" if i < 600 else "b", 0) for i in range(800)]
    spark.createDataFrame(docs, DOCS).coalesce(1).write.parquet(f"{tmp_path}/docs")
    plain = spark.read.parquet(f"{tmp_path}/docs")
    corpus_pipeline.mix(spark, plain, "").write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    position = {r.doc_id: r.position for r in mixing.schedule(plain).collect()}

    def packed(frame):
        rows = packing.pack(frame, capacity=64, group_tokens=8192, in_order=True).collect()
        groups = {}
        for r in rows:
            groups.setdefault(r.sequence_id // packing.GROUP_WINDOWS, []).append(r)
        return rows, groups

    rows, groups = packed(mixed)
    assert len(groups) == -(-sum(r.length for r in rows) // 8192) and sorted(groups) == list(range(len(groups)))
    ends = [(min(position[r.doc_id] for r in groups[g]), max(position[r.doc_id] for r in groups[g])) for g in sorted(groups)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    without, dropped = packed(plain)
    place = lambda r: (r.doc_id, r.start)
    assert sorted(map(place, rows)) == sorted(map(place, without))
    assert sorted(map(tuple, rows)) != sorted(map(tuple, without))
    # Mixing brings the second source forward.
    first = lambda g: min(k for k in g if any(docs[r.doc_id][3] == "b" for r in g[k]))
    assert first(groups) < first(dropped)


def test_rows_from_no_file_are_packed_in_order(spark):
    frame = spark.createDataFrame([(i, "w", "en", "a", 0) for i in range(100)], DOCS)
    got = packing.pack(frame, capacity=16, group_tokens=64, in_order=True).collect()
    at = [r.doc_id for r in sorted(got, key=lambda r: (r.sequence_id // packing.GROUP_WINDOWS, r.doc_id))]
    assert at == list(range(100))
    assert packing.pack(frame.limit(0), in_order=True).collect() == []


def odd_corpus():
    """Nulls in every column, empty and very long texts, repeated rows and ids,
    and columns that clash with names used inside the operators."""
    rng = random.Random(7)
    vocab = ["w%d" % i for i in range(900)]
    plain = [" ".join(rng.choice(vocab) for _ in range(80)) for _ in range(30)]
    long = " ".join(rng.choice(vocab) for _ in range(60_000))
    rows = [(i, t, "en", "a" if i % 3 else None) for i, t in enumerate(plain)]
    rows += [(None, plain[0], None, None), (None, "only here " * 30, "en", "b"), (3, plain[3], "en", "b"), (3, "another text of id three " * 20, "en", "b"), (0, plain[1], "en", "a")]
    rows += [(100, None, "en", "a"), (101, "", "en", "a"), (102, " \n\t", None, "c"), (103, long, "en", "a"), (104, long + " end", "en", "a"), (105, long, "en", None)]
    return [(i, t, lang, source, None if t is None else len(t), "clash", 1.5) for i, t, lang, source in rows]


ODD = DOCS + ", SCORE string, `position` double"


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    data = odd_corpus()
    spark.createDataFrame(data, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, now, str(tmp_path))
        if name != "pack":
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [(r[0], r[1]) for r in now.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(kept["quality"], key=key) == sorted(((r[0], r[1]) for r in data), key=key)  # no labels, no model
    groups = {}
    for i, t, *_ in data:
        groups.setdefault("".join((t or "").split()), []).append((i, t))
    best = {g: min(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g, rows in groups.items()}
    alike = lambda r, b: r[0] == b[0] and len(r[1] or "") == len(b[1] or "")
    exact = [r for g, rows in groups.items() for r in rows if alike(r, best[g])]
    assert sorted(kept["exact_dedup"], key=key) == sorted(exact, key=key)
    # The long text and its longer copy are linked; the lesser id stays.
    near = [r for r in exact if r[0] != 104]
    assert {103, 104} <= {r[0] for r in exact} and sorted(kept["near_dedup"], key=key) == sorted(near, key=key)
    assert sorted(kept["mix"], key=key) == sorted(near, key=key)
    pieces = spark.read.parquet(f"{tmp_path}/pack").collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in near}
    assert sum(r.start == 0 for r in pieces) == len(near)


def test_an_empty_table_goes_through_every_stage(spark, tmp_path):
    spark.createDataFrame([], ODD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
