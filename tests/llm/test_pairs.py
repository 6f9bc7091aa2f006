from itertools import combinations

import numpy as np
import pytest

from docloom.llm.pairs import broken_pairs, buckets, checked, templates

Q = "Why does the worker restart every queue when the lock is free, although the planner already drains it?"


@pytest.mark.parametrize(("answer", "defect"), [
    (None, "empty"), ("", "empty"), (" \t\n", "empty"), ("​", "empty"), ("N/A", "empty"), ("(no answer)", "empty"), ("...", "empty"), ("—", "empty"),
    ("No.", None), ("Yes.", None), ("42", None), ("`--dry-run`", None), ("Port 4713.", None), ("Use `worker`", None),
    ("It restarts because the lock", "truncated"), ("Call this:\n```py\nx = f(", "truncated"), ("It waits for the lock (see the", "truncated"), ("It restarts the queue,", "truncated"),
    ("```sh\nrun it\n```", None), ("- first\n- second item without a stop", None),
    (Q, "copy"), (f"You asked: {Q}", "copy"), (f"Question: {Q}\nAnswer: {Q}", "copy"), (f"**{Q}**", "copy"), (Q.replace("every", "every stray"), "copy"), (f"{Q} Yes.", None), (f"{Q}\n\nBecause the lock was free.", None),
    ("Das Gerät wird neu gestartet, sobald die Sperre frei ist und der Platz nicht reicht.", "language"), ("La cola se vacía cuando el bloqueo se libera y no antes.", "language"),
])
def test_checks(answer, defect):
    assert checked(Q, answer) == defect


THINGS = ["queue", "lock", "worker", "ledger", "router", "planner", "shard", "token"]
SUBJECT = [f"The {x} is merged with the {y} at once, so you can not rename a {x} in place; it has to be copied, released first and read on every node without the {y}. " for x in THINGS for y in THINGS if x != y]
SUBJECT += ["La fila pode ser limpa quando o bloqueio é liberado, e não antes.", "La coda si svuota quando il blocco viene rilasciato, e non prima.", "Køen tømmes når låsen er fri, og ikke før."] * 3

#: Openings that decline, in languages with and without subject texts; {} takes a word of the prompt.
REFUSALS = [
    "I'm sorry, but I can't help with that request.", "Sorry, no. That is something I won't explain.", "My guidelines prevent me from saying more about {}.",
    "Es tut mir leid, dabei kann ich leider nicht helfen.", "Il m'est impossible de vous aider sur ce sujet.", "No me está permitido responder a esta pregunta.",
    "Desculpe, mas não posso ajudar com esse pedido.", "Mi dispiace, ma non posso aiutarti con questa richiesta.", "Jeg kan desværre ikke hjælpe med den forespørgsel.",
    "I would rather not go into that here.", "Thanks for asking! Regrettably I have to pass on anything like {}. Is there something else?",
]

#: Recurring answers that decline nothing, and single ones that speak of the speaker.
ANSWERS = ["No.", "Yes.", "Only on every node.", "It is not possible to merge two of them at once.", "You can not rename a {} in place, it has to be copied first.", "The {} can not be read, it is released first."]
SINGLE = [
    "I cannot reproduce the crash of the queue on 4.2, so rename the worker and merge the shard first.", "I can't stress enough that the lock must be released first and the ledger copied on every node.",
    "I gave the worker permission to read the lock.", 'The call fails with "I am unable to assist" when the worker is copied; release it first.',
]


def _asked(spark, answers):
    rows, no = [], 0
    for answer in answers:
        for i in range(5):
            x, y = THINGS[(no + i) % 8], THINGS[(no + 3 * i + 1) % 8]
            rows.append((f"{no}-{i}", f"Why does the {x} of name{no}x{i} drain {y} number n{i * 37 + no} while level{i} waits?", answer.format(x)))
        no += 1
    rows += [(f"s{i}", f"What about case{i} of it?", a) for i, a in enumerate(SINGLE)]
    subject = spark.createDataFrame([(x,) for x in SUBJECT], "said string")
    return spark.createDataFrame(rows, "id string, q string, a string"), subject


def test_templates_reveal_refusals_in_any_language(spark):
    df, subject = _asked(spark, REFUSALS + ANSWERS)
    out = {(r.id, r.defect) for r in broken_pairs(df, "id", "q", "a", subject, "said").collect() if r.defect == "refusal"}
    assert out == {(f"{no}-{i}", "refusal") for no in range(len(REFUSALS)) for i in range(5)}


def test_one_prompt_reveals_nothing(spark):
    """The same prompt, or nearly the same, answered alike many times isn't recurrence across unrelated prompts."""
    rows = [(f"r{i}", Q, REFUSALS[0]) for i in range(20)]
    df, subject = spark.createDataFrame(rows, "id string, q string, a string"), spark.createDataFrame([(x,) for x in SUBJECT], "said string")
    assert broken_pairs(df, "id", "q", "a", subject, "said").count() == 0


def test_closing_lines_are_no_refusals(spark):
    """A courtesy that ends whole answers isn't a refusal where it follows a bare one."""
    whole = "The {} is merged with every node, so it has to be copied and released first. Let me know if something else comes up."
    rows = [(f"w{i}", f"Why does {x} of n{i} wait on m{i}?", whole.format(x)) for i, x in enumerate(THINGS)] + [("bare", "Can it?", "No. Let me know if something else comes up.")]
    df, subject = spark.createDataFrame(rows, "id string, q string, a string"), spark.createDataFrame([(x,) for x in SUBJECT], "said string")
    assert broken_pairs(df, "id", "q", "a", subject, "said").count() == 0


def test_templates_carry_their_members(spark):
    said = "We would rather leave the question about {} to your administrators"
    rows = [(f"r{i}", f"Question number {i} of n{i} and m{i}?", said.format(f"thing{i}") + (", I am not allowed to say." if i % 5 else "."), 1, "x") for i in range(20)]
    rows += [("ok", "How many?", "There are 12 of them.", 1, "x"), ("ok", "How many?", "There are 12 of them.", 1, "x"), ("none", None, "fine answer.", 1, "x")]
    df = spark.createDataFrame(rows, "id string, q string, a string, defect int, opening string")
    for subject in (spark.createDataFrame([(x,) for x in SUBJECT], "said string"), spark.createDataFrame([], "said string"), spark.createDataFrame([(None,), ("",)], "said string")):
        out = {(r.id, r.defect) for r in broken_pairs(df, "id", "q", "a", subject, "said").collect()}
        assert out == {(f"r{i}", "refusal") for i in range(20)}
    assert broken_pairs(df.limit(0), "id", "q", "a", subject, "said").count() == 0


@pytest.mark.parametrize("n", [1, 70])
def test_unrelated_least_of_a_bucket(spark, n):
    """Two alike openings whose every common bucket begins with n unrelated ones, below and above what is paired out."""
    one, other = "we would rather leave this question to administrators", "we would rather leave this question to operators"
    shared = [k for k in buckets([one])[0] if k in buckets([other])[0]]
    rng = np.random.default_rng(6)
    two = list(combinations(one.split()[:7], 2))
    tried = [" ".join([*(f"a{x}" for x in rng.integers(0, 10**9, 6)), *two[i % len(two)]]) for i in range(40_000)]
    keys = buckets(tried)
    unrelated = {tried[i] for k in shared for i in np.flatnonzero((keys == k).any(1))[:n]}
    assert shared and all((buckets(sorted(unrelated)) == k).any(1).sum() >= n for k in shared)
    openings = [one, other, *sorted(unrelated)]
    out = templates(spark.createDataFrame(list(enumerate(openings)), "code bigint, opening string")).collect()
    assert {openings[r.code] for r in out} == {one, other} and len({r.template for r in out}) == 1
