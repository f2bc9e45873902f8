import random

import pytest

from weftgraph.llm import subjects as S

NOUNS = {
    "law": ["court rulings", "statutes", "defendants", "injunctions", "bail hearings", "parole boards"],
    "sport": ["league tables", "goalkeepers", "sprint finishes", "home games", "penalty kicks", "relay teams"],
}
PLAIN = ["The learning rate was halved after 12 epochs.", "The hubs hold most of the edges.", "All indices start from zero.", "Edge weights are scaled to the unit interval."]
FORMS = ["Please add {} to the schema, next to {}.", "We link {} to {} and keep the overlap as the weight.", "Some {} carry no label at all, unlike {}."]


def sentence(r, subject, limit=6):
    a, b = r.sample(NOUNS[subject][:limit], 2)
    return r.choice(FORMS).format(a, b)


def test_prose_leaves_out_what_is_none():
    text = 'Hi all,\n\n### Bug\n1. First point here. Second one there!\n```python\nx = load(n=3)\nThis is code.\n```\n[10:00:01] epoch 1  loss=0.5\n# A comment line is prose.\nbob: We said so again.\nThanks in advance for any hint!\nTraceback (most recent call last):\n  File "a.py", line 3\nValueError: expected 3 dims.\n\n> Quoted words count too.\n--\nbob'
    assert S.prose(text) == ["First point here.", "Second one there!", "A comment line is prose.", "We said so again.", "Quoted words count too."]
    assert S.prose("The seed is 9; results shouldn&#39;t depend on it. return x;") == ["The seed is 9; results shouldn't depend on it."]
    assert S.prose(None) == S.prose("") == S.prose(" \n\t") == S.prose("+1") == S.prose("_" * 5000) == []
    assert S.prose("为什么会这样？一旦出现，就应该停止。") == ["为什么会这样?", "一旦出现,就应该停止。"]


def test_inline_value_loses_its_sentence_only():
    text = "Court rulings were compared to statutes. We set k=5 and lr=0.01 for all runs. Bail hearings carry no label."
    assert S.prose(text) == ["Court rulings were compared to statutes.", "Bail hearings carry no label."]
    assert S.prose("step=3 loss=0.5. All workers are running again.") == S.prose("[12:01] epoch 2. All workers are running again.") == []
    assert S.prose("After epoch 3 the loss=0.5 and it goes down") == []


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(1)
    docs, truth = [], {}
    for i in range(300):
        own = r.choice([["law"], ["sport"], ["law", "sport"], []])
        text = [sentence(r, s) for s in own for _ in range(4)] + [r.choice(PLAIN) for _ in range(3)]
        if own == ["law"] and i % 3 == 0:  # a passing mention
            text += [sentence(r, "law") for _ in range(8)] + [sentence(r, "sport")]
        r.shuffle(text)
        docs.append((i, " ".join(text), "x"))
        truth[i] = set(own)
    seeds = [(k, s, "en", " ".join(sentence(r, s, 4) for _ in range(4)) + " " + " ".join(r.sample(PLAIN, 2))) for k, s in enumerate(["law", "sport"] * 10)]
    return docs, truth, seeds


def test_subjects_beyond_the_seeds(table, corpus):
    docs, truth, seeds = corpus
    docs = docs + [(1000, None, "x"), (1001, "", "x"), (1002, "  \n", "x"), (1003, "done!", "x"), (0, docs[0][1], "x"), (None, docs[0][1], "x")]
    d = table(docs, "doc_id bigint, text string, t string")
    got = S.subject_areas(d, table(seeds + [(99, None, "en", "x"), (98, "other", "en", "y")], "seed_id bigint, subject string, lang string, text string"), table([("law",), ("sport",)], "subject string")).collect()
    assert len({(r["doc_id"], r["subject"]) for r in got}) == len(got)
    found = {i: set() for i in truth}
    for r in got:
        found[r["doc_id"]].add(r["subject"])
    right = sum(found[i] == truth[i] for i in truth)
    assert right >= 0.97 * len(truth)


def test_nothing(table, corpus):
    sub, seed = table([("law",)], "subject string"), "seed_id bigint, subject string, lang string, text string"
    none = table([], "doc_id bigint, text string")
    assert S.subject_areas(none, table(corpus[2], seed), sub).count() == 0
    some = table([(i, t) for i, t, _ in corpus[0][:20]], "doc_id bigint, text string")
    assert S.subject_areas(some, table([], seed), sub).count() == 0


def test_sentences_that_never_recur(table):
    """Each sentence has a word of its own, so none is known from elsewhere as a whole."""
    r = random.Random(5)
    docs, truth = [], {}
    for i in range(400):
        own = r.choice([["law"], ["sport"], []])
        text = [sentence(r, s) for s in own for _ in range(5)] + [r.choice(PLAIN) for _ in range(4)]
        r.shuffle(text)
        docs.append((i, " ".join(s[:-1] + f" of {''.join(r.choices('bcdfglmnprst', k=9))}." for s in text)))
        truth[i] = set(own)
    seeds = [(k, s, "en", " ".join(sentence(r, s, 4) for _ in range(4)) + " " + " ".join(r.sample(PLAIN, 2))) for k, s in enumerate(["law", "sport"] * 10)]
    got = S.subject_areas(table(docs, "doc_id bigint, text string"), table(seeds, "seed_id bigint, subject string, lang string, text string"), table([("law",), ("sport",)], "subject string")).collect()
    found = {i: set() for i in truth}
    for row in got:
        found[row["doc_id"]].add(row["subject"])
    assert sum(found[i] == truth[i] for i in truth) >= 0.97 * len(truth)


def test_codes_are_no_prose():
    assert S.prose("9316cf38ff706691944bb863fef4cb29e10fa2e4") == []
    assert S.prose("We saw 9316cf38ff706691944bb863fef4cb29e10fa2e4.") == ["We saw 9316cf38ff706691944bb863fef4cb29e10fa2e4."]
