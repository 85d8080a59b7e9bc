"""Personal data and secrets by weak supervision.

Candidate spans of whole texts come from several finders: the forms of each kind (addresses, numbers, keys), values that
follow a cue word ("password: ..."), and names, by a title before them or a given name that a list or the corpus knows.
Labelers vote on each: the strict form of its kind (regex), lists of known parts such as top-level domains, issuer
numbers, countries and names (gazetteer), words before it (context), a check of its digits, octets or entropy, and other
candidates nearby. Votes are for, against or none. Expectation-maximisation over the counts of all vote patterns
estimates how reliable each labeler is for each kind, and so a probability for each pattern. A logistic classifier of
the span's own form and surroundings is trained on these probabilities and decides on all spans; of accepted spans that
overlap the most probable stays, so that it also settles where a span begins and ends. Only the classifier's training
uses a sample, of at most ``TRAIN`` candidates, the least by a hash.

The list of given names is extended by the corpus: words that follow a title ``LEARNT`` times or more, over all documents.

Every finder takes time in proportion to the text: what it repeats is bounded, or begins only where a run begins.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import _runtime as rt
from quarry.llm import _text as tx
from quarry.llm._model import Sparse, fit_logistic, sigmoid

TRAIN = 50_000
ACCEPT = 0.5
LEARNT = 5
NAMES = 100_000  # learnt names that are broadcast, the most frequent ones
DIMENSIONS = 4096
LABELERS = ("form", "list", "context", "check", "nearby")
KINDS = ("email", "secret", "ip", "phone", "id", "iban", "card", "person")

_TITLE_WORDS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
_TITLES = f"(?:{'|'.join(_TITLE_WORDS)})"
_LETTERS = r"[^\W\d_]{1,40}"
_FORMS = {
    "ip": re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"),
    "phone": re.compile(r"(?<![\w])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?![\w])|(?<![\w])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?![\w])"),
    "id": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "iban": re.compile(r"(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\w])"),
    "card": re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)"),
    "person": re.compile(r"\b" + _TITLES + r"\.? {1,3}" + _LETTERS + r"(?: {1,3}[A-ZÀ-Þ]" + _LETTERS + r")?"),
}
_DIGIT = re.compile(r"\d")
_DOMAIN = re.compile(r"@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8}")
_LOCAL = re.compile(r"[\w.+%-]+\Z")
_KEY = re.compile(r"[A-Za-z0-9_+/-]{20,}={0,2}")
_CAPITALS = re.compile(r"(?<![\w'’-])([A-ZÀ-Þ]" + _LETTERS + r") {1,3}([A-ZÀ-Þ]" + _LETTERS + r")(?![\w])")
_CUED = re.compile(
    r"(?<![\w])(?:(?P<secret>password|passwd|pwd|passphrase|token|secret|api[_-]?key|apikey|access[_-]?key)|(?P<id>ssn|social security number)"
    r"|(?P<phone>phone|tel|mobile|fax|telefon|téléphone|teléfono)|(?P<email>e-?mail|correo|courriel))"
    r"[\"']?(?: {1,3}(?:is|number|no))?[ .]{0,3}[:=]{1,2} {0,3}[\"']?(?P<value>[^\s\"'<>,;]{6,128})",
    re.IGNORECASE,
)
_STRICT = {
    "email": re.compile(r"[A-Za-z0-9][\w.+%-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    "secret": re.compile(r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_\w{36}|sk-\w{20,}"),
    "ip": re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"),
    "phone": re.compile(r"\+\d{1,3} ?\(\d{2,4}\) ?\d{3}[ .-]\d{4}|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}"),
    "id": re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"),
    "iban": re.compile(r"[A-Z]{2}\d{2}[A-Z0-9 ]{11,36}"),
    "card": re.compile(r"\d{16}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|3[47]\d{13}"),
    "person": re.compile(_TITLES + r"\.? +[A-ZÀ-Þ][^\W\d_]+(?: +[A-ZÀ-Þ][^\W\d_]+)?|[A-ZÀ-Þ][^\W\d_]+ +[A-ZÀ-Þ][^\W\d_]+"),
}
#: Country-code and the commonest generic top-level domains.
_DOMAINS = frozenset(
    """ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg
    ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi
    gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky
    kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl
    no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss
    st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm
    zw com org net edu gov mil int info biz name pro aero coop museum mobi jobs travel tel cat asia post arpa dev app page blog
    shop store online site tech cloud xyz club live news email agency example test""".split()
)
#: Countries with the lengths of their account numbers.
_COUNTRIES = dict(
    (x[:2], int(x[2:]))
    for x in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18
    FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 LY25
    MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28
    TL23 TN24 TR26 UA29 VA22 VG24 XK20""".split()
)
_NAMES = frozenset(
    """aaron adam adrian agnes ahmed aisha alan albert alejandro alex alexander alexandra alfred ali alice alicia amanda amelie
    amy ana andrea andreas andrew angela anita anja anna anne antonio arthur astrid barbara beatriz ben benjamin bernard
    bernd betty birgit brian bruno camille carlos carmen carol caroline catherine cecile charles charlotte chen chloe chris
    christian christina christine christopher claire clara claudia claus colin cristina daniel daniela david deborah denise
    dennis diana diego dieter dominik donald donna dorothy eduardo edward elena elias elisabeth elizabeth emily emma eric
    erik ernst esther eva felix fernando florian frances francis francisco francois frank franz fred friedrich gabriel
    gabriele george georg gerald gerhard gisela gloria grace gregory greta guillermo gustav guy hanna hannah hans harald
    harold heather heidi heike heinrich heinz helen helena helga helmut henri henry herbert hugo ian ingrid irene isabel
    isabelle ivan jack jacob jacqueline jacques james jan jane janet jason javier jean jeffrey jennifer jens jeremy jessica
    joachim joan joanna joerg johann john jonas jonathan jorge jose josef joseph joshua juan judith julia julian julie
    julien jurgen justin karen karin karl kathleen katrin keith kelly kenneth kevin kim klaus kurt lars laura lauren
    laurent lea lena leo leon li linda lisa louis louise lucas lucia lucy luis luisa lukas lutz manfred manuel marc marcel
    marco margaret maria marie marina mario mark markus marta martha martin martina mary mathieu matthew matthias max maya
    melanie melissa michael michel michelle miguel mohamed mohammed monica monika nadia nancy natalie nicholas nicolas
    nicole nina noah nora norbert olaf oliver olivia olivier omar oscar otto pablo pamela patricia patrick paul paula pedro
    peter petra philip philippe pierre priya rachel rafael rainer ralf ralph raquel raul raymond rebecca renate rene ricardo
    richard robert roberto roger roland rosa rose ruben rudolf ruth ryan sabine samuel sandra sara sarah scott sean sebastian
    sergio sharon silvia simon sofia sonja sophie stefan stefanie stephan stephanie stephen steven susan susanne sven sylvie
    tania teresa theo theresa thomas tim timothy tobias tom udo ulrich ulrike ursula uwe valentina valerie vera veronica
    victor victoria vincent virginia walter wei werner wilhelm william wolfgang xavier yasmin yvonne zoe""".split()
)
_CUES = {
    "email": "email e-mail mail contact write send correo courriel",
    "secret": "token key secret password passwd pwd apikey api_key auth bearer credential",
    "ip": "ip address addr host server client login adresse dirección",
    "phone": "phone tel call mobile fax cell telefon téléphone teléfono",
    "id": "ssn social security",
    "iban": "iban account bank konto compte cuenta",
    "card": "card visa credit mastercard amex karte carte tarjeta",
    "person": "name contact dear from signed",
}
_CUES = {kind: frozenset(cues.split()) for kind, cues in _CUES.items()}
_AGAINST = frozenset("version v isbn doi page pages chapter section figure license licence arxiv issn rfc".split())
_WORD = re.compile(r"[^\W_]+(?:[-_][^\W_]+)*")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def _check(kind: str, span: str) -> int:
    digits = re.sub(r"\D", "", span)
    if kind == "card":
        return 1 if _luhn(digits) else 0  # numbers are often mistyped or masked, so a failure says little
    if kind == "ip":
        return 1 if all(int(x) < 256 for x in span.split(".")) else -1
    if kind == "secret":
        return 1 if _entropy(span) > 3 else -1
    if kind == "phone":
        return 1 if 9 <= len(digits) <= 14 else -1
    if kind == "iban":
        flat = span.replace(" ", "")
        number = int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4] if c.isalnum()))
        return 1 if number % 97 == 1 else -1
    if kind == "email":
        return -1 if ".." in span else 1
    if kind == "id":
        return 1 if len(set(digits)) > 2 else -1
    return 0


def _listed(kind: str, span: str, names: frozenset[str]) -> int:
    if kind == "email":
        return 1 if span.rpartition(".")[2].lower() in _DOMAINS else -1
    if kind == "card":
        return 1 if span[0] in "3456" else 0
    if kind == "iban":
        return 1 if _COUNTRIES.get(span[:2]) == len(span.replace(" ", "")) else -1
    if kind == "ip":
        return -1 if span.startswith(("0.", "127.")) or span == "255.255.255.255" else 1
    if kind == "phone":
        return 1 if span.startswith("+") else 0
    if kind == "secret":
        return 1 if span.startswith(("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xox")) else 0
    if kind == "person":
        return 1 if any(w.lower() in names for w in span.split()) else 0
    return 0


def _shape(span: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in span))


def _found(text: str, names: frozenset[str]) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, finder) of the candidates, in order, each span of a kind once."""
    spans: dict[tuple[int, int, str], str] = {}
    digit, cue = _DIGIT.search(text), ":" in text or "=" in text  # without which there is nothing to find, but names
    for kind, form in _FORMS.items():
        if any(t in text for t in _TITLE_WORDS) if kind == "person" else digit:
            for m in form.finditer(text):
                spans[m.start(), m.end(), kind] = "form"
    for m in _DOMAIN.finditer(text):
        at = max(0, m.start() - 64)
        if local := _LOCAL.search(text[at : m.start()]):
            spans[at + local.start(), m.end(), "email"] = "form"
    for m in _KEY.finditer(text) if digit else ():
        span, s, e = m[0], m.start(), m.end()
        beside = text[s - 1 : s] + text[e : e + 1]
        if not any(c.isalnum() for c in beside) and any(c.isdigit() for c in span) and any(c.isalpha() for c in span):
            spans[s, e, "secret"] = "form"
    for m in _CAPITALS.finditer(text):
        if m[1].lower() in names:
            spans.setdefault((m.start(), m.end(), "person"), "list")
    for m in _CUED.finditer(text) if cue else ():
        value = m["value"].rstrip(".)]}!?:")
        if len(value) >= 6 and (any(c.isdigit() for c in value) or "@" in value):
            spans.setdefault((m.start("value"), m.start("value") + len(value), m.lastgroup if m.lastgroup != "value" else next(k for k in ("secret", "id", "phone", "email") if m[k])), "cue")
    return sorted((s, e, kind, finder) for (s, e, kind), finder in spans.items())


def candidates(text: str, names: frozenset[str] = _NAMES) -> list[tuple[int, int, str, tuple[int, ...], list[str], int]]:
    """(start, end, kind, votes, features, group) of each candidate of a text, by characters; those that overlap one
    another, directly or by others, are a group, named by its start."""
    found = _found(text, names)
    out = []
    group, reach = -1, -1
    for i, (start, end, kind, finder) in enumerate(found):
        if start >= reach:
            group = start
        reach = max(reach, end)
        span, before = text[start:end], text[max(0, start - 40) : start]
        cut = before.rfind("\n") + 1
        near = [w.lower() for w in _WORD.findall(before[cut:])][-4:]
        context = 1 if finder == "cue" or _CUES[kind] & set(near) else -1 if near and near[-1] in _AGAINST else 0
        beside = any(
            abs(found[j][0] - start) < 400 and (found[j][1] <= start or found[j][0] >= end) for j in (i - 1, i + 1) if 0 <= j < len(found)
        )
        strict = _STRICT[kind].fullmatch(span)
        votes = (
            1 if strict else 0 if kind == "secret" and finder == "cue" else -1,
            _listed(kind, span, names),
            context,
            _check(kind, span),
            1 if beside else 0,
        )
        digits = sum(c.isdigit() for c in span)
        features = [
            f"k={kind}",
            f"k={kind} l={min(len(span) // 4, 16)}",
            f"k={kind} d={digits * 8 // len(span)}",
            f"k={kind} s={_shape(span)[:24] if kind != 'secret' else ''}",
            f"k={kind} x={span[:1] if not span[:1].isalnum() else ''}{text[end : end + 1] if not text[end : end + 1].isalnum() else ''}",
            f"k={kind} w={near[-1] if near and (near[-1] in _AGAINST or near[-1] in _CUES[kind]) else ''}",
            f"k={kind} f={votes[0]} {finder}",
        ]
        out.append((start, end, kind, votes, features, group))
    return out


_SCHEMA = "doc_id long, rid long, place long, start long, end long, kind int, " + ", ".join(f"{x} int" for x in LABELERS) + ", features array<int>"


def _titled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, n): words that follow titles."""
    for batch in batches:
        counts = Counter()
        for text in batch.column(0):
            for m in _FORMS["person"].finditer(text.as_py()):
                counts.update(w.lower() for w in m[0].split()[1:] if w[:1].isupper())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["name", "n"])


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in rt.chunks(batches, rows=512):
            ids, rids, rows, names = [], [], [], []
            for doc_id, rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for start, end, kind, votes, features, group in candidates(text.as_py(), known):
                    ids.append(doc_id)
                    rids.append(rid)
                    rows.append((group, start, end, KINDS.index(kind), *votes))
                    names.append(features)
            flat = pa.array([f for fs in names for f in fs], pa.string())
            hashed = pa.array((tx.hash_strings(flat) % np.uint64(DIMENSIONS)).astype(np.int32))
            offsets = pa.array(np.cumsum([0] + [len(fs) for fs in names]).astype(np.int32))
            numbers = np.array(rows, np.int64).reshape(-1, 4 + len(LABELERS))
            kinds = [pa.int64()] * 3 + [pa.int32()] * (1 + len(LABELERS))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(rids, pa.int64()),
                    *(pa.array(np.ascontiguousarray(numbers[:, i])).cast(k) for i, k in enumerate(kinds)),
                    pa.ListArray.from_arrays(offsets, hashed),
                ],
                ["doc_id", "rid", "place", "start", "end", "kind", *LABELERS, "features"],
            )

    return run


def em(votes: np.ndarray, counts: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(probability of each pattern, reliabilities[labeler, class, vote + 1], share of true spans) for one kind.

    Starts from the majority. The prior gives labelers some weight for voting right, so that the classes keep their
    meaning where votes are one-sided.
    """
    n = votes.shape[1]
    p = sigmoid(1.5 * votes.sum(axis=1).astype(float))
    table = np.zeros((n, 2, 3))
    share = 0.5
    for _ in range(steps):
        weight = np.stack((counts * (1 - p), counts * p))
        share = (weight[1].sum() + 2) / (counts.sum() + 4)
        for j in range(n):
            for c in (0, 1):
                table[j, c] = [weight[c][votes[:, j] == v].sum() for v in (-1, 0, 1)]
            table[j] += np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])
        table /= table.sum(axis=2, keepdims=True)
        z = np.log(share) - np.log(1 - share) + sum(np.log(table[j, 1, votes[:, j] + 1] / table[j, 0, votes[:, j] + 1]) for j in range(n))
        now = sigmoid(z)
        if np.abs(now - p).max(initial=0) < 1e-9:
            break
        p = now
    return p, table, share


def _decide(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = weights.value
        names = pa.array(KINDS)
        for batch in batches:
            lists = batch.column(6)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            p = sigmoid(np.bincount(rows, w[lists.flatten().to_numpy()], minlength=batch.num_rows) + b)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], names.take(batch.column(5)), pa.array(p)], ["doc_id", "rid", "place", "start", "end", "kind", "probability"]
            )

    return run


def _settled(spans: DataFrame) -> DataFrame:
    """Of overlapping spans the most probable, then the longest, then the first; a group has the few that overlap."""
    rank = F.struct((-F.col("probability")).alias("p"), (F.col("start") - F.col("end")).alias("l"), "start", "end", "kind")
    groups = spans.groupBy("doc_id", "rid", "place").agg(F.array_sort(F.collect_set(rank)).alias("ranked"))
    none = F.filter("ranked", lambda x: F.lit(False))
    taken = F.aggregate(
        "ranked",
        none,
        lambda kept, x: F.when(
            F.exists(kept, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])), kept
        ).otherwise(F.concat(kept, F.array(x))),
    )
    return (
        groups.select("doc_id", F.explode(taken).alias("x"))
        .select("doc_id", "x.start", "x.end", "x.kind", (-F.col("x.p")).alias("probability"))
        .distinct()
    )


def personal_data(docs: DataFrame, train: int = TRAIN) -> DataFrame:
    """Spans of personal data and secrets: doc_id, start and end (characters, exclusive), kind, probability.

    Defined cases: a null or empty text has no spans, and a very long one is scanned whole. A null doc_id stays null.
    Rows that repeat an id and a text give their spans once; with differing texts the spans of each. Of overlapping spans
    that tie in probability the longest stays, then the first. Other columns, whatever their names, are not read. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), "text").where("text <> ''")
    learnt = (
        texts.where(reduce(Column.__or__, (F.contains("text", F.lit(t)) for t in _TITLE_WORDS)))
        .select("text")
        .mapInArrow(_titled, "name string, n long")
        .groupBy("name")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= LEARNT)
        .orderBy(F.col("n").desc(), "name")
        .limit(NAMES)
    )
    names = _NAMES | {row["name"] for row in learnt.collect()}  # NAMES at most
    found = rt.written(texts.mapInArrow(_scan(spark.sparkContext.broadcast(names)), _SCHEMA), "pii-candidates")
    patterns = found.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).toArrow()  # 3^5 for each kind at most
    kind = patterns["kind"].to_numpy()
    votes = np.stack([patterns[x].to_numpy() for x in LABELERS], axis=1) if len(patterns) else np.zeros((0, len(LABELERS)), int)
    counts = patterns["n"].to_numpy().astype(float)
    known: dict[tuple[int, ...], float] = {}
    for k in sorted(set(kind.tolist())):
        mine = kind == k
        p, _, _ = em(votes[mine].astype(int), counts[mine])
        known.update({(k, *v): float(x) for v, x in zip(votes[mine].tolist(), p, strict=True)})
    order = (F.xxhash64("doc_id", "start", "end"), "doc_id", "start", "end", "kind")
    sample = found.orderBy(*order).limit(train).select("kind", *LABELERS, "features").toArrow()
    keys = zip(*(sample[c].to_pylist() for c in ("kind", *LABELERS)), strict=True)
    y = np.array([known[k] for k in keys])
    lists = sample["features"].combine_chunks() if len(sample) else pa.array([], pa.list_(pa.int32()))
    x = Sparse(np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), DIMENSIONS)
    model = fit_logistic(x, y, np.ones(len(y)), 1e-5, steps=200)
    spans = found.select("doc_id", "rid", "place", "start", "end", "kind", "features").mapInArrow(
        _decide(spark.sparkContext.broadcast(model)),
        "doc_id long, rid long, place long, start long, end long, kind string, probability double",
    )
    return _settled(spans.where(F.col("probability") >= ACCEPT))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(rt.documents(spark, sf_dir))


QUERIES = {"op7_pii": op7_pii}
SQL: dict[str, str] = {}
