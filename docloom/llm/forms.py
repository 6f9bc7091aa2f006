"""Problem 9: one consistent form for texts that look the same but are written with other characters.

Characters: invisible ones go (a joiner between two emoji stays, as it changes the picture), blanks of any width become a
space, runs of them one space, line ends LF, hyphens the plain one, wide and narrow forms and f-ligatures their plain letters, and composed and
decomposed accents one form. Case, accents, raised digits and signs such as an ellipsis stay as they are.

Letters: script-aware repair of look-alikes. A token that mixes scripts is rewritten in its dominant script (or, if that
gives no word, in the other one); a token wholly of foreign look-alikes is mixed with the rest if the text is in another
script. An accent over a look-alike goes with it. The rewritten token must exist in the corpus: as a token of one script
in any document, or as the rewriting of another spelling. The check of all corpus tokens against the wanted ones goes through a bit table of bounded size and a join, so
no vocabulary is collected.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.words import _HASHES, bit_table, bits_for, looked_up, pairs_within, per_text
from docloom.session import stored

#: Letters of other scripts that look like the Latin letter.
LOOKALIKES = dict(zip(
    "аеорсухѕіјһԁԛԝӏѵүАВЕЅІЈКМНОРСТХУԌԚԜӀѴҮ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿοϲϳναρι" "օոսհցքՕՍՏ" "ᎪᎬᎻᎷᏔᏚᎢᏟᏢᏦᏃᏙᎫᏞ" "ⲟⲥⲢⲞⲤ",
    "aeopcyxsijhdqwlvyABESIJKMHOPCTXYGQWIVY" "ABEZHIKMNOPTYXCJocjvapi" "onuhgpOUS" "AEHMWSTCPKZVJL" "ocPOC",
))
_TO_LATIN = str.maketrans(LOOKALIKES)
#: Those letters, and letters composed of one of them and accents.
_FOREIGN = re.compile("[" + "".join(LOOKALIKES) + "".join(c for c in map(chr, range(0x370, 0x2000)) if unicodedata.normalize("NFD", c)[0] in LOOKALIKES and c not in LOOKALIKES) + "]")
_SCRIPTS = ("CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC")
_TO_SCRIPT = {s: str.maketrans({b: a for a, b in reversed(LOOKALIKES.items()) if unicodedata.name(a).startswith(s)}) for s in _SCRIPTS}

#: Characters without any shape of their own.
_INVISIBLE = "­͏؜᠎​‌‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩"
_BLANKS = "\t\x0b\x0c\xa0              　"
_LIGATURES = {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl", 0xFB05: "st", 0xFB06: "st"}

_CHANGES: dict[int, str] = {ord(c): "" for c in _INVISIBLE} | {0xFEFF: ""} | {ord(c): " " for c in _BLANKS} | _LIGATURES
_CHANGES |= {c: unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFFEF) if unicodedata.decomposition(chr(c)).startswith(("<wide>", "<narrow>"))}
#: Hyphens that look like the one of ASCII.
_CHANGES |= {0x2010: "-", 0x2011: "-", 0xFE63: "-"}
_JOINER = re.compile("(?<![\u2300-\u2bff\U0001f000-\U0001ffff\ufe0f])\u200d|\u200d(?![\u2300-\u2bff\U0001f000-\U0001ffff])")
_RUN = re.compile(" {2,}")
_LINE = re.compile(" *(?:\r\n|\r|\n| | |\x85) *")
_TOKEN = re.compile("[^\\W_][^\\W_\u0300-\u036f]*(?:[\u0300-\u036f]+[^\\W_]*)*")


def plain(text: str) -> str:
    """The text in one form, look-alike letters aside. '' if nothing is visible."""
    if not text.isascii():
        text = text.translate(_CHANGES)
        text = _JOINER.sub("", text) if "\u200d" in text else text
        text = unicodedata.normalize("NFC", text)
    elif "\t" in text or "\x0b" in text or "\x0c" in text:
        text = text.translate(_CHANGES)
    text = _LINE.sub("\n", text)
    return _RUN.sub(" ", text).strip()


@lru_cache(10_000)
def script(c: str) -> str | None:
    """The script of a letter, as far as it matters here; None for digits and marks."""
    if c < "\x80":
        return "LATIN" if c.isalpha() else None
    if not c.isalpha():
        return None
    name = unicodedata.name(c, "")
    return "LATIN" if name.startswith("LATIN") else next((s for s in _SCRIPTS if name.startswith(s)), "OTHER")


def _counts(token: str) -> dict[str, int]:
    counts: dict[str, int] = {}
    for c in token:
        if s := script(c):
            counts[s] = counts.get(s, 0) + 1
    return counts


_LATIN_TWINS = set(LOOKALIKES.values())


def rewritings(token: str, of_text: str) -> list[str]:
    """The one-script rewritings of a token to look up, the preferred one first. Its dominant script is the one with most
    letters of its own, that is, without a look-alike in the other; without any, the script of the text."""
    token = unicodedata.normalize("NFD", token)
    counts = _counts(token)
    foreign = [s for s in _SCRIPTS if s in counts]
    if "OTHER" in counts or not foreign:
        return []
    own = _counts("".join(c for c in token if c not in LOOKALIKES and c not in _LATIN_TWINS))
    prefer = max(own, key=lambda s: own[s]) if own else of_text
    if len(counts) == 1 and prefer == foreign[0]:
        return []
    latin = token.translate(_TO_LATIN)
    to_latin = [unicodedata.normalize("NFC", latin)] if _counts(latin).keys() <= {"LATIN"} else []
    if len(counts) == 1:
        return to_latin
    others = []
    for s in sorted(foreign, key=lambda x: (x != prefer, -counts[x])):
        there = latin.translate(_TO_SCRIPT[s])
        if _counts(there).keys() == {s}:
            others.append(unicodedata.normalize("NFC", there))
    return others + to_latin if prefer in foreign else to_latin + others


def dominant(text: str) -> str:
    counts = _counts(text)
    return max(counts, key=lambda s: counts[s]) if counts else "LATIN"


def _key(text: str) -> bytes | None:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest() if text else None


_FORMS = "form binary, raw binary, plain string, wanted array<struct<token: string, to: string, choice: int>>"


def _formed(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (key, form, raw, plain, wanted): form is the hash of the text's one form, or, where tokens may
    have to be rewritten, null with the text and those tokens. with_text: the text is held in any case."""
    kind = pa.list_(pa.struct([("token", pa.string()), ("to", pa.string()), ("choice", pa.int32())]))
    for batch in batches:
        form, raw, held, wanted = [], [], [], []
        for t in batch.column(1).to_pylist():
            u = plain(t or "")
            tokens = []
            if u and not u.isascii() and _FOREIGN.search(u):
                of_text = dominant(u)
                for token in dict.fromkeys(x for x in _TOKEN.findall(u) if _FOREIGN.search(x)):
                    tokens += [{"token": token, "to": to, "choice": i} for i, to in enumerate(rewritings(token, of_text))]
            form.append(None if tokens else _key(u))
            raw.append(_key(t or ""))
            held.append(u if tokens or with_text else None)
            wanted.append(tokens or None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(form, pa.binary()), pa.array(raw, pa.binary()), pa.array(held, pa.string()), pa.array(wanted, kind)], names=["key", "form", "raw", "plain", "wanted"])


def _known(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(to): the wanted tokens that some text has in one script, or that two spellings in the corpus lead to (they look the
    same and must compare as equal, whether or not the plain spelling is written anywhere)."""
    tokens = stored(wanted.groupBy("to").agg(F.countDistinct("token").alias("spellings")))
    hashes = tokens.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([_HASHES[x] - (1 << 64) * (_HASHES[x] >> 63) for x in b.column(0).to_pylist()], pa.int64())], names=["h"]) for b in batches), "h bigint")
    table = bit_table(hashes, "h", bits_for(tokens.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may, seen = looked_up(table.value), {}
        for batch in per_text(batches, 1024):
            found = set().union(*(_TOKEN.findall(plain(t)) for t in batch.column(0).to_pylist()))
            new = [x for x in found if x not in seen]
            if len(seen) > 200_000:
                seen.clear()
            hit = may(np.array([_HASHES[x] for x in new], np.uint64)) if new else []
            seen.update(dict.fromkeys(new))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, ok in zip(new, hit) if ok], pa.string())], names=["to"])

    there = texts.select("text").filter("text is not null").mapInArrow(run, "to string").distinct()
    return tokens.join(there, "to", "left_semi").select("to").union(tokens.filter("spellings > 1").select("to")).distinct()


def one_form(df: DataFrame, key: str, text: str, with_text: bool = False) -> DataFrame:
    """(key, form, raw) for each row: form is the hash of the text's one form, raw of its characters; with_text adds the
    form itself. Texts that are null, empty or have nothing visible get a null form. Texts look alike if their forms are
    equal. Other columns are ignored; repeated rows stay."""
    kind = df.schema[key].dataType.simpleString()
    texts = df.select(df[key].alias("key"), df[text].alias("text"))
    forms = texts.mapInArrow(lambda x: _formed(x, with_text), f"key {kind}, {_FORMS}")
    forms = stored(forms)
    wanted = forms.select("key", "raw", F.explode("wanted").alias("w")).select("key", "raw", "w.*")
    known = _known(texts, wanted.select("token", "to").distinct())
    chosen = wanted.join(known, "to").groupBy("key", "raw").agg(F.collect_set(F.struct("token", "choice", "to")).alias("chosen"))
    waiting = forms.filter("wanted is not null").select("key", "raw", "plain").join(chosen, ["key", "raw"], "left")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, chosen in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                to = {}
                for x in sorted(chosen or [], key=lambda x: x["choice"]):
                    to.setdefault(x["token"], x["to"])
                out.append(_TOKEN.sub(lambda m, to=to: to.get(m[0], m[0]), t) if to else t)
            columns = [batch.column(0), pa.array([_key(t) for t in out], pa.binary()), batch.column(1)]
            names = ["key", "form", "raw"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.string())] if with_text else columns, names=[*names, "text"] if with_text else names)

    rewritten = waiting.mapInArrow(rewrite, f"key {kind}, form binary, raw binary" + ", text string" * with_text)
    done = forms.filter("wanted is null").select("key", "form", "raw", *[F.col("plain").alias("text")] * with_text)
    return done.union(rewritten)


def alike_pairs(forms: DataFrame) -> DataFrame:
    """(id_a, id_b): pairs of keys whose texts have one form but not the same characters. Grouped by form and raw first,
    so forms with one spelling only, however many copies they have, give no work."""
    spelled = stored(forms.filter("form is not null").select("form", "raw", "key").distinct())
    several = spelled.groupBy("form").agg(F.min("raw").alias("x"), F.max("raw").alias("y")).filter("x <> y").select("form")
    rows = spelled.join(several, "form")
    return pairs_within(rows, "form", "key", ["raw"]).filter("raw_a <> raw_b").select("id_a", "id_b").distinct()
