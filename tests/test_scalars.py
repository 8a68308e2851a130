from pyspark.sql import functions as F

from stromalens.functions import scalars as S


def one(spark, *cols, rows=((1,),), schema="i int"):
    return spark.createDataFrame(list(rows), schema).select(*cols).collect()


def test_pick_column(spark):
    df = spark.createDataFrame([(1, 2)], "`Cluster-ID` int, ` gene name ` int")
    assert S.pick_column(df, ["group", "cluster id"]) == "Cluster-ID"
    assert S.pick_column(df, ["Gene_Name"]) == " gene name "
    assert S.pick_column(df, ["x"]) is None


def test_dirty_numbers(spark):
    raw = ["", " 3.0 ", "nan", "inf", "x", "1e3", None, "1d", "0x1p3", "-2.9"]
    rows = one(spark, S.safe_double("s", 9.0), S.safe_long("s", 9), S.canonical_id("s"), rows=[(r,) for r in raw], schema="s string")
    assert [r[0] for r in rows] == [9.0, 3.0, 9.0, 9.0, 9.0, 1000.0, 9.0, 9.0, 9.0, -2.9]
    assert [r[1] for r in rows] == [9, 3, 9, 9, 9, 1000, 9, 9, 9, -2]
    assert [r[2] for r in rows] == [None, "3", "nan", "inf", "x", "1000", None, "1d", "0x1p3", "-2"]


def test_feature_modality(spark):
    names = ["EPCAM", "PROTEIN_CD3", "ADT_PD1", "COL1A1", "cd8"]
    got = [r[0] for r in one(spark, S.feature_modality("s", ["CD8"]), rows=[(n,) for n in names], schema="s string")]
    assert got == ["rna", "protein", "protein", "rna", "protein"]


def test_units_and_chain(spark):
    rows = [(12.75, 8.5)]
    r = one(spark, S.um_to_px("x", 0.25), S.um_to_px("y", 0.25), S.px_to_um(S.um_to_px("x")), *S.transform_chain(
        "x", "y", [{"type": "scale", "x": 2, "y": 2}, {"type": "translation", "x": 10, "y": -4}]), rows=rows, schema="x double, y double")[0]
    assert tuple(r) == (51.0, 34.0, 12.75, 35.5, 13.0)


def test_affine_inverse():
    m = (2.0, 0.5, 3.0, -1.0, 4.0, -1.0)
    inv = S.invert_affine(m)
    x, y = 2 * 7 + 0.5 * 5 + 3, -7 + 4 * 5 - 1
    assert abs(inv[0] * x + inv[1] * y + inv[2] - 7) < 1e-12 and abs(inv[3] * x + inv[4] * y + inv[5] - 5) < 1e-12
    assert S.rescale_affine(m, 2, 4) == (4.0, 2.0, 3.0, -2.0, 16.0, -1.0)


def test_names(spark):
    r = one(spark, S.slug(F.lit("a b//c__")), S.slug(F.lit("**")), S.selection_name(F.lit(2), F.lit("[x]"), F.lit(1), F.lit(3), F.lit(False)),
            S.hex_to_rgb(F.lit("#6EF0D4")), S.signal_bucket(F.lit("Invasive tumor, blurred")), S.barcode_stem(F.lit("AA-1")))[0]
    assert tuple(r) == ("a_b_c", "contour", "S2 x #1.3", [110, 240, 212], "artifact_signal", "AA")


def test_hash_is_stable(spark):
    import hashlib
    import json
    m = {"b": 'q"é', "a": "1"}
    want = hashlib.sha256(json.dumps(m, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    make = F.create_map(F.lit("b"), F.lit(m["b"]), F.lit("a"), F.lit("1"))
    assert one(spark, S.input_hash(make))[0][0] == want


def test_jitter_matches_digest(spark):
    import hashlib
    d = hashlib.sha1(b"AAA-1").digest()
    want = [(int.from_bytes(d[i:i + 4], "little") / 2**32 - 0.5) * 0.08 for i in (0, 4)]
    got = one(spark, *S.stable_jitter(F.lit("AAA-1")))[0]
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-15


def test_text_list_shapes(spark):
    cases = ['null', '" a "', '{"k": 1, "e": ""}', '["x", " ", {"y": 1}]', '7', 'broken', None, '""', '{}', '[]']
    got = [r[0] for r in one(spark, S.text_list("s"), rows=[(c,) for c in cases], schema="s string")]
    assert got == [[], ["a"], ["k: 1"], ["x", '{"y":1}'], ["7"], [], [], [], [], []]


def test_extract_json(spark):
    cases = ['x ```json\n{"a": 1}\n``` y', 'say {"a": {"b": 2}} end', "none", "} {"]
    got = [r[0] for r in one(spark, S.extract_json_text("s"), rows=[(c,) for c in cases], schema="s string")]
    assert got == ['{"a": 1}', '{"a": {"b": 2}}', None, None]
