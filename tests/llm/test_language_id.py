from frames import messy_rows

from seriesloom.llm.language_id import UNKNOWN, identify, train_dictionaries, words_only

GERMAN = "der hund und die katze gehen nicht in das haus und schlafen auf dem sofa weil es regnet"
ENGLISH = "the dog and the cat do not go into the house and sleep on the sofa because it rains"


def labelled(spark):
    rows = [(f"{GERMAN} {i}", "de") for i in range(30)] + [(f"{ENGLISH} {i}", "en") for i in range(30)] + [(None, "fr"), ("oui", None)]
    return spark.createDataFrame(rows, "text string, lang string")


def test_learns_and_rejects(spark):
    models = train_dictionaries(labelled(spark))
    assert sorted(models) == ["de", "en"]
    texts = [(1, "the cat and the dog sleep in the house"), (2, "die katze und der hund schlafen nicht"), (3, None), (4, "12 -- !!"), (5, ""), (6, "zq"), (7, ENGLISH * 2000)]
    found = {r["id"]: r for r in identify(spark.createDataFrame(texts, "id int, text string"), models).collect()}
    assert (found[1]["lang_pred"], found[2]["lang_pred"], found[7]["lang_pred"]) == ("en", "de", "en")
    assert not found[1]["rejected"] and not found[2]["rejected"] and not found[7]["rejected"]
    assert all(found[i]["lang_pred"] == UNKNOWN and found[i]["rejected"] and found[i]["score"] == 0 for i in (3, 4, 5))
    assert found[6]["rejected"] and all(0 <= r["score"] <= 1 for r in found.values())


def test_model_does_not_depend_on_order(spark):
    rows = labelled(spark)
    assert train_dictionaries(rows.repartition(7)) == train_dictionaries(rows.coalesce(1))
    assert train_dictionaries(rows.limit(0)) == {}


def test_messy(spark, messy, nothing):
    models = train_dictionaries(messy)
    found = identify(messy, models)
    assert found.count() == len(messy_rows()) and {r["row"] for r in found.collect()} == {"row"}
    assert {r["lang_pred"] for r in identify(messy, {}).collect()} == {UNKNOWN}
    assert identify(nothing, models).count() == 0
    assert words_only("Ab3c__D\n\té") == "ab c d é"


def test_copies_leave_the_other_texts_in_the_sample(spark):
    """A large group of copies in a small language counts as one text."""
    copies = spark.range(20_000).selectExpr("'xx yy zz' AS text", "'xx' AS lang")
    others = spark.range(50).selectExpr("concat('quel autre texte ', translate(id, '0123456789', 'abcdefghij')) AS text", "'xx' AS lang")
    content = train_dictionaries(copies.unionByName(others), sample_texts=40)["xx"]
    assert content.count(b"quel autre texte") >= 39
