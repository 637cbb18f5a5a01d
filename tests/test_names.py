import pytest
from pyspark.sql import functions as F

from parallax.functions import names


def table(spark, *said):
    return spark.createDataFrame([(n,) for n in said], "player string")


def keyed(spark, *said):
    return [r["k"] for r in table(spark, *said).select(names.keys("player").alias("k")).collect()]


@pytest.mark.parametrize(("said", "roman"), [("박새롬", "bak sae rom"), ("독고윤", "dok go yun"), ("최빛나", "choe bit na"), ("a 곽x", "a gwak x")])
def test_romanization(spark, said, roman):
    assert table(spark, said).select(names.romanized(F.col("player"))).first()[0] == roman


@pytest.mark.parametrize(("a", "b"), [("Nam Dae-sol", "Dae Sol Nam"), ("Gon-Woo Oh", "Oh Gon-woo"), ("Tomás Ibáñez*", "Tomas Ibanez"), ("Baek, Sol Min", "Sol Min Baek"), ("Ｎam Dae Sol", "Nam Dae Sol")])
def test_strict_equal(spark, a, b):
    x, y = keyed(spark, a, b)
    assert x["strict"] == y["strict"] and x["strict"]


@pytest.mark.parametrize(("a", "b"), [("Paek Sol-min", "Sol Min Baek"), ("박새롬", "Sae Rom Park"), ("최빛나", "Bit Na Choi"), ("Yim Cheol Su", "Lim Chul Soo"), ("Dae Sol Nam", "Tae Sol Nam")])
def test_loose_equal(spark, a, b):
    x, y = keyed(spark, a, b)
    assert x["loose"] == y["loose"] and x["loose"]


@pytest.mark.parametrize(("a", "b"), [("Dae Sol Nam", "Gon Woo Oh"), ("Walter Quill", "Edgar Finch"), ("Sae Rom Park", "Dae Sol Nam")])
def test_loose_different(spark, a, b):
    x, y = keyed(spark, a, b)
    assert x["loose"] != y["loose"]


def test_surnames(spark):
    def split(said):
        found = names.parts(F.lit(said))
        return spark.range(1).select(names.keys(F.lit(said))["surname"], F.transform(found, lambda p: p["text"]), names.surname_at(F.lit(said), found)).first()

    assert tuple(split("Sae Rom Park")) == ("PARK", ["Sae", "Rom", "Park"], 2)
    assert tuple(split("Walter Quill Jr.")) == (None, ["Walter", "Quill"], None)
    assert tuple(split("Min-Ho Lee Sung")) == ("LEE", ["Min", "Ho", "Lee", "Sung"], 2)
    found = spark.createDataFrame([("yuh",), ("chon",), ("choe",), ("quill",), (None,)], "t string").select(names.surname_class(F.col("t"))).collect()
    assert [r[0] for r in found] == ["RYU", "JEON", "CHOI", None, None]
    assert [(k["strict"], k["loose"]) for k in keyed(spark, "", "***", " , ")] == [(None, None)] * 3


def test_korean_names(spark):
    assert [k["is_korean"] for k in keyed(spark, "Dae Sol Nam", "박새롬", "Walter Quill", "Nam Alexander Maximilian", None)] == [True, True, False, False, False]


def test_keys_and_their_steps(spark):
    rows = table(spark, "Nam Dae-sol*", "남대솔", None, "Gon Woo (LHP)  Oh#", "Tomás Ibáñez", "ﬁn Öz")
    got = rows.select(names.keys("player").alias("k"), names.clean(F.col("player")).alias("clean"), names.plain(F.col("player")).alias("plain"), names.has_hangul(F.col("player")).alias("h"), names.letters(F.col("player")).alias("l")).collect()
    assert [r["k"]["clean"] for r in got] == [r["clean"] for r in got] and got[3]["clean"] == "Gon Woo Oh"
    assert got[0]["k"]["loose"] == got[1]["k"]["loose"] and got[1]["h"] and got[2]["k"]["strict"] is None
    assert got[4]["plain"] == "Tomas Ibanez" and got[5]["l"] == "finoz"
    tokens = spark.createDataFrame([(t,) for t in ("Hoo", "Jeong", "Seung", "kkwak", "Noh", "Byung")], "t string")
    assert [r[0] for r in tokens.select(names.loose_token(F.col("t"))).collect()] == ["ho", "jong", "song", "gwag", "no", "byong"]


def test_no_python_runs(spark):
    text = table(spark, "x").select(names.keys("player").alias("k"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


@pytest.mark.parametrize(
    ("name", "city", "wanted"),
    [("Dae Sol Nam", "Osaka, JP", (True, "name (born abroad)")), ("Walter Quill", None, (False, "name")), ("Walter Quill", "Austin, TX", (False, "birthplace")), ("Walter Quill", "Busan, KR", (True, "birthplace")), ("Gon Woo Oh", "nan", (True, "name"))],
)
def test_nationality(spark, name, city, wanted):
    row = spark.createDataFrame([(name, city)], "player string, city string")
    flag, signal = names.nationality(names.keys("player")["is_korean"], F.col("city"))
    assert tuple(row.select(flag, signal).first()) == wanted
