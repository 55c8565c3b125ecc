import random

import pytest

from driftloom.llm.defects import DEFECTS, copy_lead, is_copy, is_empty
from driftloom.llm.languages import language_named, language_of
from driftloom.llm.pairs import _slot, defective_pairs, features, p6_found, pair_rows, train, training_set, verdict, with_limits
from driftloom.sources.tables import table
from pair_rules import defect_of, is_refusal

ASK = "Explain how the parser works and what it must check before the next run."


@pytest.mark.parametrize("text", [None, "", " \t", "​", '""', "{}", "[]", '{"a": {"b": []}}', "```\n```", "```json\n{}\n```", "''"])
def test_empty(text):
    assert is_empty(text)


@pytest.mark.parametrize("text", ["0", "x", '{"a": 0}', "```\nx\n```", "-"])
def test_not_empty(text):
    assert not is_empty(text)


@pytest.mark.parametrize("text", ["I cannot help with that.", "Sorry, no. Please ask someone else.", '{"error": "I must decline to document this."}', "Leider darf ich das nicht beschreiben.", "Ich muss das ablehnen.", "Я не могу помочь с этим запросом.", "My policy does not permit me to answer this."])
def test_refusal(text):
    assert is_refusal(text)


@pytest.mark.parametrize("text", ["This helper can't be called twice.", "I cannot see any caller, so only the path matters. The parser reads it.", "The guard refuses requests without a lease.", "Sorry messages are rendered by `x`."])
def test_answers_are_no_refusals(text):
    assert not is_refusal(text)


def test_copies():
    assert copy_lead(ASK, "Sure: " + ASK) == 4 and copy_lead(ASK, ASK + " x") is None
    for c in (ASK, ASK.upper(), "> " + ASK, f'"{ASK}"', "Sure: " + ASK, ASK.replace(" ", "\n")):
        assert is_copy(ASK, c)
    assert not is_copy(ASK, ASK + " The parser reads the file and returns it to its caller.")
    assert not is_copy(None, ASK) and not is_copy(ASK, None)


def test_long_defects_are_no_exception(spark):
    refusal = "I cannot help with that. " * 100
    hollow = '{"sections": {' + ", ".join(f'"part {i}": [""]' for i in range(300)) + "}}"
    padded = ASK[:20] + " \n" * 700 + ASK[20:]
    deep = "[" * 200_000 + "]" * 200_000
    assert is_refusal(refusal) and not is_refusal(refusal + "The parser reads the file.")
    assert is_empty(hollow) and not is_empty(hollow.replace('"part 7": [""]', '"part 7": ["x"]')) and is_copy(ASK, padded)
    assert is_empty(deep) and not is_empty(deep[:-1]) and not is_empty("[" * 200_000 + "1" + "]" * 200_000)
    rows = [(i, "", ASK, f"The parser number {i} reads the file and returns it to its caller.") for i in range(40)]
    rows += [(90, "", ASK, refusal), (91, "", ASK, hollow), (92, "", ASK, padded)]
    got = defective_pairs(spark.createDataFrame(rows, "id long, system string, user string, response string"))
    assert {(r.id, r.defect) for r in got.collect()} == {(90, "refusal"), (91, "empty"), (92, "copy")}


def test_features_see_whole_texts():
    slots = lambda r: set(features("", "zebra", r)[0].tolist())
    assert _slot("e ?") in slots("word " * 1000 + "ends here ?") and 19 in slots("word " * 1000 + "zebra.")


def test_style_at_a_field_limit_is_truncated(spark):
    at = "- one thing is read by the parser\n- the " + "parser checks the file and " * 6
    rows = [(i, "a" if i < 20 else "b", "", ASK, at[:200]) for i in range(21)]
    rows += [(100 + i, "a", "", ASK, "The parser reads the file " + "and checks it " * (i // 14) + "w" * (i % 14) + ".") for i in range(60, 300)]
    pairs = spark.createDataFrame(rows, "id long, feed string, system string, user string, response string")
    assert {(r.id, r.defect) for r in defective_pairs(with_limits(pairs)).filter("id < 100").collect()} == {(i, "truncated") for i in range(20)}


def test_languages():
    assert language_of("Der Parser liest die Datei und gibt sie zurück.") == "de"
    assert language_of("`code` 12") is None and language_of(None) is None
    assert language_named("Antworte auf Englisch.") == "en" and language_named("Output language: ru.") == "ru" and language_named("`German`") is None


def test_order_of_defects():
    assert defect_of("", ASK, None) == "empty"
    assert defect_of("", ASK, "Der Parser liest die") == "truncated"
    assert defect_of("Answer in German.", ASK, "The parser reads the file.") == "other_language"
    assert defect_of("Answer in German.", ASK, f'"{ASK[:40]}"\n\nDer Parser liest die Datei und prüft sie.') is None
    assert defect_of("", None, "Fine.") is None


def _rows(spark, data):
    return [tuple(r) for r in pair_rows(table(spark, data, "llm_stages")).select("system", "user", "response").collect()]


@pytest.fixture(scope="module")
def split(spark, data):
    """A model of half of the larger table's pairs, and the other half."""
    rows = _rows(spark, data.replace("sf0.001", "sf0.1"))
    random.Random(0).shuffle(rows)
    half = len(rows) // 2
    return train(training_set(rows[:1200])), rows[half:]


def test_held_out_recall_and_precision(split):
    """The classifier against the written-out rules of `pair_rules`, which it does not know."""
    model, rows = split
    for label in DEFECTS:
        both = found = true = 0
        for r in rows:
            got, want = verdict(model, *r) == label, defect_of(*r) == label
            both, found, true = both + (got and want), found + got, true + want
        assert true > 30 and both >= 0.95 * true and both >= 0.95 * found, (label, true, found, both)


UNSEEN = [
    "That is beyond my remit; ask the owners.", "This isn't something I'm comfortable with.", "I can't engage with that topic.", "Not possible, my guidelines rule this out.",
    "I'm going to sit this one out, sorry.", "We are unable to process requests of this kind.", "Dazu kann ich keine Angaben machen.", "Ich bin nicht dazu berechtigt, darüber zu sprechen.",
    "Эту задачу я выполнять не буду.", "Je ne peux malheureusement pas traiter cette demande.", "Lo siento, pero no me corresponde hacerlo.", "Przepraszam, nie mogę w tym pomóc.",
]


def test_refusals_in_words_that_training_lacks(split):
    model, rows = split
    user = next(r[1] for r in rows if r[1])
    assert sum(verdict(model, "", user, x) == "refusal" for x in UNSEEN) >= 0.9 * len(UNSEEN)
    answers = ["The guard refuses requests without a lease.", "This helper can't be called twice.", "I cannot see any caller, so only the path matters. The parser reads it and keeps it sorted.", "Der Parser darf die Datei nicht zweimal lesen."]
    assert not any(verdict(model, "", None, x) == "refusal" for x in answers)


def test_other_languages(split):
    model, _ = split
    french = "Le lecteur ouvre le fichier et vérifie les lignes avant de les rendre à la fonction."
    assert language_of(french) == "fr" and language_of("El lector abre el archivo y comprueba las líneas.") == "es"
    assert verdict(model, "", ASK, french) == "other_language" and verdict(model, "Answer in French.", ASK, french) is None


def test_operator_on_odd_tables(spark, data):
    schema = "stage_id long, system string, user string, response string"
    rows = [(1, None, None, None), (2, "", ASK, "x" * 100_000), (3, "", ASK, ASK), (3, "", ASK, ASK)]
    got = {(r.stage_id, r.defect) for r in defective_pairs(spark.createDataFrame(rows, schema)).collect()}
    assert got <= {(1, "empty"), (2, "truncated"), (3, "copy")}
    assert defective_pairs(spark.createDataFrame([], schema)).count() == 0
    assert {r.defect for r in p6_found(spark, data).collect()} <= set(DEFECTS)
