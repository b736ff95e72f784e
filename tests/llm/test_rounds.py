"""Rows that repeat an id in the near-duplicate stage; packing beyond one group."""


def test_bins_of_all_groups_meet(spark):
    from sylva.llm.packing import pack

    rows = [(k, 0, 0, 3, k) for k in range(1000)] + [(1000, 0, 0, 1, 1)]
    got = pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), 64, group_rows=20)
    fills = got.groupBy("sequence_id").sum("length").collect()
    assert got.count() == 1001 and max(r[1] for r in fills) <= 64
    assert sum(r[1] <= 32 for r in fills) <= 1  # two half-empty sequences would have been one


def test_nearly_full_bins_close(spark):
    from sylva.llm.packing import pack

    # each bin of 2046 and one of 2 would be full; 1 does not fit anywhere worth a round
    rows = [(k, 0, 0, 2046, k) for k in range(300)] + [(1000 + k, 0, 0, 700, k) for k in range(600)] + [(5000, 0, 0, 1, 1)]
    got = pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), 2048, group_rows=100)
    fills = sorted(r[1] for r in got.groupBy("sequence_id").sum("length").collect())
    assert got.count() == 901 and fills[-1] <= 2048 and len(fills) <= 300 + 300 + 1


def test_repeated_ids(spark, sf_dir):
    import corpus_pipeline as C

    text = "one two three four five six seven eight"
    clean = "a text of its own that is nowhere else at all"
    rows = [(1, text), (2, text), (2, clean), (3, "this row is here twice and should stay once"), (3, "this row is here twice and should stay once")]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = sorted((r.doc_id, r.text) for r in C.keep_one_of_near_copies(spark, docs, sf_dir).collect())
    assert kept == [rows[0], rows[2], rows[3]]
