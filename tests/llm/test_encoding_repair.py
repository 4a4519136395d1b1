import random

import pytest
from pyspark.sql import functions as F

from pagequarry.llm import encoding_repair as er

WORDS = {
    "fr": "théières rénovées étagères brûlées fenêtres dorées crémiers légères",
    "pl": "łóżka świeże krzesła żółte książki ścierki małe źródła",
    "ru": "зелёные шторы подушки прочные скамейки новые ложки ковры",
    "de": "schöne Körbe günstige Blumentöpfe Löffel rötliche Türgriffe",
    "es": "montañas españolas cómodas jardín añejas balcón prácticas",
    "en": "you’ll keep “sturdy” toolbox – compare with café-style blanket …",
}


def texts(n=60):
    rng = random.Random(4)
    return [f"{' '.join(rng.choices(w.split(), k=4))} No{rng.randrange(99)}" for w in WORDS.values() for _ in range(n)]


@pytest.fixture(scope="module")
def judge(spark):
    return er.fit(spark.createDataFrame([(t,) for t in texts()], "t string"), "t").ready()


@pytest.mark.parametrize("wrong", ["latin-1", "cp1252", "cp1251", "mac_roman", "cp437", "cp850", "iso8859-2"])
def test_utf8_read_as_another_encoding_is_restored(judge, wrong):
    page = er._page(wrong)
    for t in texts(5):
        garbled = "".join(page[b] for b in t.encode())
        if garbled != t:
            v = judge.decide(garbled)
            assert v.garbled and v.text == t, (t, garbled, v)


def test_twice_partly_and_lost(judge):
    page = er._page("cp1252")
    bad = lambda t: "".join(page[b] for b in t.encode())
    t = "théières rénovées No7"
    assert judge.decide(bad(bad(t))).text == t
    assert judge.decide(f"{bad('théières')} brûlées No3").text == "théières brûlées No3"
    assert judge.decide("".join(c for c in bad("małe łóżka książki") if not "\x80" <= c <= "\x9f")).garbled
    v = judge.decide("th�i�res No1")
    assert v.garbled and v.text == "th�i�res No1" and v.chain == ""


def test_swapped_cyrillic_and_polish(judge):
    assert judge.decide("новые скамейки зелёные шторы".encode("cp1251").decode("latin-1")).text == "новые скамейки зелёные шторы"
    assert judge.decide("новые скамейки прочные шторы".encode("koi8-r").decode("cp1251")).text == "новые скамейки прочные шторы"


def test_correct_text_stays(judge):
    for t in [*texts(), "ÂNCORA & PÃO", "Buy sturdy doormat · ÂNCORA & PÃO", "buy sturdy doormat · âncora & pão", "théâtres plâtres", "½ m² ±5°", "&eacute; %C3%A9", "日本語の写真", "", "plain", "LÂMPADA", "No.º 5 « à »"]:
        v = judge.decide(t)
        assert not v.garbled and v.text == t, v


def test_repair_rows(spark):
    model = er.Model({})
    rows = [(1, "cafÃ©", None, "x"), (1, "cafÃ©", None, "x"), (2, None, "", "x"), (3, "café", "x" * 100000 + "Ã©", "x"), (4, "�", "ok", "x")]
    df = spark.createDataFrame(rows, "n int, original string, field string, id string")
    got = sorted(tuple(r) for r in er.repair(df, "n", ["original", "field"], model).select("id", "field", "repaired").distinct().collect())
    assert got == [(1, "original", "café"), (3, "field", "x" * 100000 + "é"), (4, "original", "�")]
    assert er.repair(df.limit(0), "n", ["original"], model).count() == 0


def test_fit_on_nothing(spark):
    model = er.fit(spark.createDataFrame([(None,), ("",)], "t string"), "t")
    assert model.ready().decide("cafÃ©").text == "café"


def test_samples_are_bounded(spark):
    df = spark.range(500).select(F.concat(F.lit("théières "), F.col("id").cast("string")).alias("t"))
    assert len(er.fit(df, "t", sample_texts=10).dictionaries["fr"]) < 400
