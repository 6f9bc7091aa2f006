"""Problem 5: broken prompt and response pairs, each with the name of its defect.

Refusals. What a refusal says isn't about the subject: of each response the sentences are taken whose words are neither
the prompt's nor those of the subject's own texts, in any language. These openings are clustered by MinHash, each held
against the others of every bucket it falls into, and those whose words verify form a template. A template that recurs
across unrelated prompts, after which most responses say next to nothing else, and which is about the speaker or has no
word of the subject, is a refusal, with all its closed responses. No phrase of refusal is listed anywhere, and a single
response is never judged by itself. That something in the system is impossible is said in the subject's own words.

The other defects are checks of a single pair: nothing visible or a placeholder (empty), nothing but the prompt's words
(copy), function words of another language than the prompt's (language), and an end inside a sentence, bracket or code
block (truncated). A pair has the first that holds of empty, refusal, copy, language, truncated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.near import meetings, rest_of_hot, shared, with_both
from docloom.llm.words import hashed, mixed, word_array, words
from docloom.operators.components import connected_components
from docloom.session import stored

BANDS, ROWS, LEAST_PROMPTS, LIKE = 8, 2, 3, 0.5

#: A word belongs to the subject if at least this share of the subject's texts have it.
SUBJECT_SHARE = 0.001

#: A word says nothing on what a prompt is about if at least this share of the prompts, and so many of them, have it.
PROMPT_SHARE, LEAST_USUAL = 0.01, 10

#: A sentence is foreign to the subject with at least so many foreign words and this share of them; an answer says next
#: to nothing else with at most so many words in other sentences; a template has hardly a word of the subject above this.
LEAST_FOREIGN, FOREIGN, MOST_REST, ALL_FOREIGN = 2, 0.35, 3, 0.75

#: What stands for a missing answer, without the signs around it.
PLACEHOLDERS = frozenset((
    "todo", "to do", "tbd", "tba", "to be done", "to be determined", "to be announced", "n a", "na", "none", "null", "nil",
    "nan", "no answer", "empty", "fixme", "xxx", "placeholder", "pending", "unanswered", "missing", "undefined", "blank",
    "no response", "not available", "not applicable", "answer", "answer here", "coming soon", "keine antwort",
    "sans réponse", "sin respuesta", "pas de réponse",
))

#: Frequent function words.
FUNCTION_WORDS = {k: frozenset(v.split()) for k, v in {
    "en": "the a an of to and is are was be been being in on at that this these when whenever if by for with as it its not must may can could you we they how what why where which who does do did into from or but has have than then only before after every each without until so because while although already there",
    "de": "der die das den dem des ein eine einen einem einer und oder ist sind war nicht mit von vom zu zum zur im in auf für wenn dass wird werden sobald bei beim nach vor ohne auch noch wie warum kann ich wer wo nur bis aus an am sich außerdem danach deshalb durch über unter jede jedem jeder weitere während",
    "fr": "le la les l d un une des du de et ou est sont ne pas par pour que qui quoi dans sur avec sans sous dès lorsque il elle ce cette ces au aux en jusqu jusque après avant chaque comment pourquoi faire plus encore si à pendant ensuite",
    "es": "el la los las un una unos unas de del y o es son no por para que con sin en al se su sus lo cuando hasta después antes cada cómo qué todavía si más tras solo sobre durante primero entre",
}.items()}

_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
_FENCE = re.compile(r"^ {0,3}```", re.M)
_QUOTED = re.compile(r'"[^"\n]*"|“[^”\n]*”|„[^“\n]*“|«[^»\n]*»')
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n+")
_LABELS = frozenset("question answer you asked q a frage antwort pregunta respuesta réponse prompt response".split())
_ENDED = ".!?。！？…"
_CLOSERS = " \t\r\n​﻿*_~\"'”’»)]}"
_LIST_ITEM = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s|\s*\|")
#: Words by which the one who answers speaks of themselves: pronouns, and first-person verbs of languages
#: that leave the pronoun out.
SPEAKER = frozenset((
    "i me my myself mine we us our ours "
    "ich mir mich mein meine meinem meinen wir uns unser unsere "
    "je me moi mon ma mes nous notre nos j "
    "yo me mi mis mí nosotros nuestra nuestro puedo siento lamento debo podemos "
    "eu me mim meu minha nós nosso posso sinto devo podemos "
    "io mi me mio mia noi nostro posso dispiace devo possiamo "
    "ik mij mijn wij ons onze jeg mig min mit vi os jag mig mitt oss minä en olen ja mnie mogę"
).split())


def language(text: str) -> str | None:
    """The language by function words outside code; None if there is too little to tell."""
    text = _CODE.sub(" ", text)
    kana = sum("぀" <= c <= "ヿ" or "一" <= c <= "鿿" for c in text)
    if kana * 4 > len(text.strip()):
        return "ja"
    said = words(text)
    counts = {k: sum(w in v for w in said) for k, v in FUNCTION_WORDS.items()}
    best, second = sorted(counts.values(), reverse=True)[:2]
    return max(counts, key=lambda k: counts[k]) if best >= 2 and best > second else None


def _outweighs(text: str, one: str, other: str) -> bool:
    """Whether words that only language `one` has are at least two and twice those that only the other has."""
    if "ja" in (one, other):
        return True
    said, a, b = words(_CODE.sub(" ", text)), FUNCTION_WORDS[one], FUNCTION_WORDS[other]
    return (n := sum(w in a and w not in b for w in said)) >= 2 and n >= 2 * sum(w in b and w not in a for w in said)


def is_empty(answer: str | None) -> bool:
    said = words(answer)
    return not said or (len(said) <= 4 and " ".join(said) in PLACEHOLDERS)


def is_copy(question: str, answer: str) -> bool:
    """Nothing but the prompt: runs of three or more of its words, with labels, at most two stray words between them
    and none behind the last."""
    asked, said = words(question), words(answer)
    if not asked or len(set(asked) & set(said)) < 0.6 * len(set(asked)):
        return False
    n = min(3, len(asked))
    runs = {tuple(asked[i : i + n]) for i in range(len(asked) - n + 1)}
    covered = [False] * len(said)
    for i in range(len(said) - n + 1):
        if tuple(said[i : i + n]) in runs:
            covered[i : i + n] = [True] * n
    stray = [i for i, w in enumerate(said) if not covered[i] and w not in _LABELS]
    return len(stray) <= 2 and (not stray or any(covered[stray[-1] :]))


def is_truncated(answer: str) -> bool:
    text = answer.rstrip(" \t\r\n​﻿")
    if len(_FENCE.findall(text)) % 2:
        return True
    prose = _CODE.sub("x", text)
    if "`" in prose:
        return True
    depth = {"(": 0, "[": 0, "{": 0}
    for c in prose:
        if c in depth:
            depth[c] += 1
        elif (o := {")": "(", "]": "[", "}": "{"}.get(c)) and depth[o]:
            depth[o] -= 1
    if any(depth.values()):
        return True
    last = text.split("\n")[-1]
    if text.endswith("`") or text.rstrip(_CLOSERS)[-1:] in _ENDED or text.rstrip(_CLOSERS).endswith("`"):
        return False
    if text[-1] in ",;:(-/&=+":
        return True
    return not _LIST_ITEM.match(last) and len(text.split()) > 3


def checked(question: str | None, answer: str | None) -> str | None:
    """The defect of a pair, refusals aside."""
    if answer is None or is_empty(answer):
        return "empty"
    if question and is_copy(question, answer):
        return "copy"
    if question:
        asked, said = language(question), language(answer)
        if asked and said and asked != said and _outweighs(answer, said, asked):
            return "language"
    return "truncated" if is_truncated(answer) else None


_FACTORS = np.random.default_rng(5).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def common_words(texts: DataFrame, text: str, share: float, least: int = 1) -> frozenset[str]:
    """The words that at least `share` of the texts, and at least `least` of them, have, counted over all texts. There are
    at most 1 / share times the mean number of distinct words of a text, however many texts there are."""
    texts = texts.select(texts[text].alias("text")).filter("text is not null")
    n = texts.count()
    counts = texts.select(F.explode(F.array_distinct(word_array(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return frozenset(r.word for r in counts.filter(F.col("df") >= max(share * n, least)).select("word").toLocalIterator())


def foreign_sentences(question: str | None, answer: str, subject: frozenset[str]) -> tuple[list[tuple[list[str], float, bool]], bool]:
    """The sentences of an answer whose wording isn't the subject's, and whether the answer says next to nothing else.

    A sentence is given by its words that neither the subject nor the prompt has, with their share in its words that the
    prompt hasn't, and whether it speaks of the speaker. Code and quotations don't count."""
    asked, out, rest = frozenset(words(question)), [], 0
    for sentence in _SENTENCE.split(_QUOTED.sub(" ", _CODE.sub(" ", answer))):
        said = list(dict.fromkeys(words(sentence)))
        own = [w for w in said if w not in asked]
        foreign = [w for w in own if w not in subject]
        if len(foreign) >= LEAST_FOREIGN and len(foreign) >= FOREIGN * len(own):
            out.append((foreign, len(foreign) / len(own), not SPEAKER.isdisjoint(said)))
        elif not sentence.rstrip().endswith("?"):
            rest += len(own)
    return out, rest <= MOST_REST


def buckets(openings: list[str]) -> np.ndarray:
    """The buckets of each opening, a row each: two minima of its words make one."""
    h, starts = hashed([s.split(" ") for s in openings])
    if not openings:
        return np.zeros((0, BANDS), np.int64)
    low = np.stack([np.minimum.reduceat(mixed(h * f), starts[:-1]) for f in _FACTORS], 1).reshape(len(openings), BANDS, ROWS)
    return mixed(low[:, :, 0] * np.uint64(31) + low[:, :, 1] + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def templates(openings: DataFrame) -> DataFrame:
    """(code, template): verified MinHash clusters of distinct openings (code, opening), words in order between blanks;
    the template is a number; an opening alone isn't listed. Any two that share a bucket are held against each other, in
    large buckets as near.py does it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = buckets(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), BANDS)))], names=["variant", "code"])

    codes = openings.select("code", "opening")
    rows = stored(codes.mapInArrow(run, "variant bigint, code bigint"))
    met = stored(meetings(rows))

    alike, held = shared(LIKE), codes.select("code", F.array_distinct(F.split("opening", " ")).alias("words"))
    edges = stored(alike(with_both(met.filter("not hot"), held)))
    rest = rest_of_hot(met, rows, edges, held, alike)
    if rest is not None:
        edges = edges.union(rest)
    return connected_components(edges).select(F.col("vertex").alias("code"), F.col("component").alias("template"))


def _marked(h: str) -> list[Column]:
    """Whether each of 256 places has been taken by a hash, in four numbers, so that the places merge at any stage."""
    place = F.col(h).bitwiseAND(F.lit(255))
    return [F.coalesce(F.bit_or(F.when(F.shiftright(place, 6) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int")))), F.lit(0).cast("bigint")).alias(f"{h}{k}") for k in range(4)]


def refusing(said: DataFrame, with_subject: bool) -> DataFrame:
    """(code) of the openings that refuse. said: (code, opening, share, speaker, closed, prompt, p, q), a row for each
    foreign sentence of an answer; p and q are two minima of the prompt's own words (those that few prompts have, if any).

    The openings are clustered into templates. A template refuses if it recurs across unrelated prompts (both minima take
    at least LEAST_PROMPTS different places), most of its answers say next to nothing else, and it is about the speaker
    or has hardly a word of the subject. The counts of an opening are summed up before it is joined with its template, so
    an opening that a third of all answers share is one row."""
    sums = [F.count("*").alias("n"), F.sum(F.col("closed").cast("int")).alias("closed"), F.sum(F.col("speaker").cast("int")).alias("speaker"), F.sum("share").alias("share")]
    openings = stored(said.groupBy("code").agg(F.first("opening").alias("opening"), *sums, *_marked("p"), *_marked("q")))
    parts = openings.drop("opening").join(templates(openings), "code", "left").withColumn("template", F.coalesce("template", "code"))
    marks = [f"{h}{k}" for h in "pq" for k in range(4)]
    whole = parts.groupBy("template").agg(*[F.sum(c).alias(c) for c in ("n", "closed", "speaker", "share")], *[F.bit_or(c).alias(c) for c in marks])
    places = lambda h: sum((F.bit_count(f"{h}{k}") for k in range(1, 4)), F.bit_count(f"{h}0"))
    unrelated = (places("p") >= LEAST_PROMPTS) & (places("q") >= LEAST_PROMPTS)
    about = F.col("speaker") * 2 > F.col("n")
    if with_subject:
        about = about | (F.col("share") >= ALL_FOREIGN * F.col("n"))
    return parts.join(whole.filter(unrelated & (F.col("closed") * 2 > F.col("n")) & about).select("template"), "template").select("code")


def broken_pairs(df: DataFrame, key: str, question: str, answer: str, subject: DataFrame, text: str) -> DataFrame:
    """(key, defect) of each defective pair. subject: texts on what the pairs are about, in the column `text`; without any,
    no wording is the subject's and only openings about the speaker can refuse.

    A null question has no copy or language defect. Repeated rows count once; a key with several pairs may have several
    defects. Other columns are ignored. A refusal whose opening recurs for fewer than three unrelated prompts isn't
    revealed by it and isn't found."""
    kind = df.schema[key].dataType.simpleString()
    known = df.sparkSession.sparkContext.broadcast(common_words(subject, text, SUBJECT_SHARE))
    usual = df.sparkSession.sparkContext.broadcast(common_words(df, question, PROMPT_SHARE, LEAST_USUAL))
    has_subject = bool(known.value)
    sentence = pa.list_(pa.struct([("opening", pa.string()), ("share", pa.float64()), ("speaker", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            found = [checked(q, a) for q, a in pairs]
            said = [([], False) if d == "empty" else foreign_sentences(q, a, known.value) for d, (q, a) in zip(found, pairs)]
            out = [[{"opening": " ".join(w), "share": s, "speaker": me} for w, s, me in x] or None for x, _ in said]
            asked = [words(q) for q, _ in pairs]
            h, starts = hashed([[w for w in x if w not in usual.value] or x or [""] for x in asked])
            least = [pa.array(np.minimum.reduceat(mixed(h * f), starts[:-1]).view(np.int64)) if len(pairs) else pa.array([], pa.int64()) for f in _FACTORS[:2]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(out, sentence), pa.array([c for _, c in said], pa.bool_()), *least], names=[key, "defect", "said", "closed", "p", "q"])

    pairs = df.select(df[key], df[question].alias("q"), df[answer].alias("a")).distinct()
    rows = stored(pairs.mapInArrow(run, f"`{key}` {kind}, defect string, said array<struct<opening: string, share: double, speaker: boolean>>, closed boolean, p bigint, q bigint"))
    said = rows.select(key, "closed", "p", "q", F.explode("said").alias("s")).select(key, "closed", "p", "q", "s.*").withColumn("code", F.xxhash64("opening"))
    codes = refusing(said, has_subject)
    refused = said.filter("closed").join(codes, "code").select(key, F.lit("refusal").alias("refusal")).distinct()
    named = rows.select(key, "defect", "closed").join(refused, key, "left")
    defect = F.when((F.coalesce("defect", F.lit("")) != "empty") & F.col("closed"), F.coalesce("refusal", "defect")).otherwise(F.col("defect"))
    return named.select(key, defect.alias("defect")).filter("defect is not null").distinct()
