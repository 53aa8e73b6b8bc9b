"""Punkt on a text with known counts and sentences."""

import pyarrow as pa
import pytest

from kindred.operators import punkt as module
from kindred.operators.punkt import CONTEXT, WORD, Model, Punkt, beside, contexts_of, counted, learn, line_tokens, sentences_column, split, train

TEXT = "What a day... Hello John. What is that you're doing? Mr. Lozano was not around today. Say hello to your mom for me!"


def test_sentences_with_a_model(spark):
    punkt = Punkt(Model(abbreviations={"mr"}, contexts={"what": 2, "hello": 40, "say": 2, "mr.": 2, "lozano": 8, "john": 4}))
    assert punkt(TEXT) == ["What a day...", "Hello John.", "What is that you're doing?", "Mr. Lozano was not around today.", "Say hello to your mom for me!"]
    text = "(Hello.) Goodbye Mr. Jones. What are you doing?"
    assert punkt.spans(text, realign=False) == [(0, 7), (7, 27), (28, 47)]
    assert punkt.spans(text) == [(0, 8), (9, 27), (28, 47)]
    assert punkt("") == []
    df = spark.createDataFrame([(TEXT,), (None,)], "t string")
    got = [r.s for r in df.select(sentences_column(punkt.model, "t").alias("s")).collect()]
    assert got == [punkt(TEXT), None]


def test_training(spark):
    text = "Hello John. What is that you're doing? Mr. Lozano was not around today. Say hello to you mom for me!"
    model = train(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), id_col="id")
    assert model.abbreviations == {"mr"}
    want = {"me": 32, "what": 2, "around": 32, "for": 32, "that": 32, "doing": 32, "is": 32, "say": 2, "to": 32, "mr.": 2, "lozano": 8, "mom": 32, "not": 32, "you": 32, "john": 4, "was": 32, "hello": 40, "today": 32}
    assert {k: v for k, v in model.contexts.items() if k.isalpha() or k == "mr."} == want
    assert train(spark.createDataFrame([], "id long, text string")).abbreviations == set()


ODD = ["Mr. Smith. . . went, . . . home.\n\nHe paid $3.50; A. B. e.g. there... ok?Yes!no", "", " ", "a.b?c.!d. x" + "?" * 50 + " y", "-mr. U.S., is. 5. Of \"Quoted.\" Next.--Then \x1c a\u00a0b.\r\nFoo."]


@pytest.mark.parametrize("text", [TEXT, *ODD])
def test_shorter_ways(text):
    for line in text.split("\n"):
        assert line_tokens(line) == WORD.findall(line)
    assert [m.span() for m in contexts_of(text)] == [m.span() for m in CONTEXT.finditer(text)]


def test_texts_of_one_id_are_trained_by_themselves(spark):
    rows = [(k, x) for k, x in enumerate([TEXT, *ODD] * 3)]
    each = train(spark.createDataFrame(rows, "id long, text string"), id_col="id")
    assert train(spark.createDataFrame([(1, x) for _, x in rows], "id long, text string"), id_col="id") == each
    assert each.contexts["hello"] == 40


def test_split_joins_the_contexts_that_a_text_asks_for(spark):
    docs = spark.createDataFrame(list(enumerate([TEXT, *ODD, None, TEXT])), "id long, text string")
    want = Punkt(train(docs))
    got = {r.id: (r.text, r.sentences) for r in split(docs, learn(docs)).collect()}
    assert got == {r.id: (r.text, None if r.text is None else want(r.text)) for r in docs.collect()}


def test_counts_are_sent_on_in_portions(monkeypatch):
    """What a kernel holds and sends at once does not grow with the texts."""
    monkeypatch.setattr(module, "HELD", 100)
    texts = [" ".join(f"w{'abcdefghij'[k % 10]}{'abcdefghij'[j % 10]}{'abcdefghij'[j // 10]}. Then" for k in range(10)) for j in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for kernel in (counted, beside(frozenset())):
        sent = list(kernel(iter([batch])))
        assert len(sent) > 5 and max(b.num_rows for b in sent) < 150
    assert sum(sum(b.column("k").to_pylist()) for b in counted(iter([batch]))) == 2000
