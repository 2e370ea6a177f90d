import numpy as np
from fieldglass.llm import media as M
from pyspark.sql import functions as F

IMAGES = "media_id long, media binary"


def picture(seed):
    return M._picture(np.random.default_rng(seed).normal(size=64))


def test_decode():
    image = picture(1)
    assert np.array_equal(M.decode(M.encode(image)), image)
    assert np.array_equal(M.decode(b"P5 # note\n2 1\n255\n\x01\x02"), [[1, 2]])
    assert M.decode(b"P6\n1 1\n255\n\xff\xff\xff")[0, 0] > 254
    for bad in (None, b"", b"P5", b"P5\n9 9\n255\n1", b"P5\n2 1\n65535\n1234", b"PNG?", b"P5 x"):
        assert M.decode(bad) is None


def test_copies_are_found_and_others_not(spark):
    rows = []
    for i in range(24):
        rows.append((i, bytearray(M.encode(picture(i)))))
        if i % 2 == 0:
            rows.append((100 + i, bytearray(M.encode(M.edited(picture(i), i)))))
    rows += [(200, rows[0][1]), (201, None), (202, bytearray(b"")), (203, bytearray(b"junk")), (204, bytearray(b"junk")), (None, bytearray(b"other"))]
    df = spark.createDataFrame(rows, IMAGES).withColumn("item", F.lit("x")).withColumn("bands", F.lit("y"))
    got = {r["media_id"]: (r["class_id"], r["class_size"]) for r in M.image_classes(df).collect()}
    right = sum(got[100 + i][0] == i for i in range(0, 24, 2))
    assert right >= 11
    assert all(got[i][0] == i for i in range(24))
    assert got[200][0] == 0
    assert got[201] == got[202] == (201, 2) and got[203] == got[204] == (203, 2)
    assert got[None] == (None, 1)


def test_recall_of_edited_copies():
    """Held against comparing every edited copy with every picture."""
    whole = [M.describe([picture(i).astype(np.float32)])[0] for i in range(30)]
    found = wrong = 0
    for i in range(30):
        copy = M.describe([M.decode(M.encode(M.edited(picture(i), i)))])[0]
        hits = [j for j in range(30) if M.same_scene(copy.tobytes(), whole[j].tobytes())]
        met = [j for j in hits if set(M.table_keys(copy)) & set(M.table_keys(whole[j]))]
        found += i in met
        wrong += any(j != i for j in hits)
    assert found >= 27 and wrong == 0


def test_turned_and_shrunk():
    image = picture(40)
    a = M.describe([image.astype(np.float32)])[0]
    b = M.describe([np.rot90(image).astype(np.float32)])[0]
    assert M.same_scene(a.tobytes(), b.tobytes())


def test_empty_and_plain(spark):
    assert M.image_classes(spark.createDataFrame([], IMAGES)).collect() == []
    plain = bytearray(M.encode(np.full((100, 100), 7)))
    got = M.image_classes(spark.createDataFrame([(1, plain), (2, plain)], IMAGES)).collect()
    assert {(r["class_id"], r["class_size"], r["corners"]) for r in got} == {(1, 2, 0)}
