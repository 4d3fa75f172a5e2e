"""Personal data by weak supervision: labelers vote on spans, EM weighs the votes, a classifier decides."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textlab.llm.common import fit_logistic, in_batches
from textlab.sources.sinks import materialise

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "national_id", "person", "address", "birth_date")
LABELERS = ("shape", "checksum", "gazetteer", "cue", "counter_cue", "border")

# The patterns of the base kinds, in forms that read each character once.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wide patterns of further candidates, and for some a strict shape.
_DIGIT = re.compile("[0-9]")
_AT = re.compile(r"\s?(?:\(at\)|\[at\]|\{at\}|\sat\s)\s?", re.I)
# An address has at most 64 signs before the at and 63 in a label behind it.
_AT_LEFT = re.compile(r"\w[\w.+-]{0,63}\Z")
_AT_RIGHT = re.compile(r"\w[\w-]{0,62}(?:(?:\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\sdot\s)\w[\w-]{0,62})+", re.I)
_AT_RIGHT_PLAIN = re.compile(r"\w[\w-]{0,62}(?:\.\w[\w-]{0,62})+")
_SIGN = re.compile("[:=]")
_KEY_LEFT = re.compile(r"(?<!\w)(?:api[_-]?key|access[_-]?key|auth|bearer|token|secret|password|passwd|pwd|key)\s{0,4}\Z", re.I)
_KEY_RIGHT = re.compile(r"\s{0,4}[\"']?([^\s\"'<>]{8,})")
_CANDIDATES = {
    "phone": re.compile(r"[(0-9](?<![\w.+-].)(?:(?<=\()[0-9]{2,5}\)|(?<=[0-9])[0-9]{1,5})[ ./-][0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![\w-])"),
    "iban": re.compile(r"[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "national_id": re.compile(r"[0-9](?<![\w-].)[0-9]{2}[- ][0-9]{2}[- ][0-9]{4}(?![\w-])"),
    "person": re.compile(
        r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Sir|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.? [^\W\d_a-z]\w{1,30}(?: [^\W\d_a-z]\w{1,30})?"
    ),
    "address": re.compile(
        r"(?<!\w)[0-9]{1,5} (?:[^\W\d_a-z]\w{1,30} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Dr)\b"
        r"|(?<!\w)[^\W\d_a-z]\w{1,30}(?:straße|strasse|weg|platz|gasse) [0-9]{1,4}\b"
    ),
    "birth_date": re.compile(r"[0-9](?<![\w./-].)(?:[0-9]?[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{2})(?![\w/-])"),
}
_WITH_DIGITS = frozenset(("phone", "iban", "national_id", "address", "birth_date"))
# Texts without these words cannot hold the candidate; saves the slow scans.
_NEEDS = {
    "person": re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Sir|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.? "),
    "address": re.compile(r"Street|St|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Dr|straße|strasse|weg|platz|gasse"),
}


def _hidden_emails(text: str):
    """Addresses written out: "name (at) host.org", "name at host dot org"."""
    low = text.lower()
    if not (" dot " in low or "at)" in low or "at]" in low or "at}" in low):
        return
    end = 0
    for m in _AT.finditer(text):
        left = _AT_LEFT.search(text[max(end, m.start() - 64) : m.start()])
        right = _AT_RIGHT.match(text, m.end()) or (m.group().strip().lower() != "at" and _AT_RIGHT_PLAIN.match(text, m.end()))
        if left and right:
            end = right.end()
            yield m.start() - len(left.group()), end


def _secrets(text: str):
    """Values after a key word and a sign: whole runs without blanks, however long. A sign within
    a value starts none of its own."""
    end = 0
    for m in _SIGN.finditer(text):
        if m.start() >= end and _KEY_LEFT.search(text[max(0, m.start() - 16) : m.start()]) and (value := _KEY_RIGHT.match(text, m.end())):
            end = value.end()
            yield value.span(1)


_STRICT = {
    "email": re.compile(r"\w[\w.+-]*\s?(?:\(at\)|\[at\]|\{at\}|\sat\s)\s?\w[\w-]*(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?\w[\w-]*)+", re.I),
    "phone": re.compile(r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|0[0-9]{1,4}[ /-][0-9]{5,8}"),
    "secret": re.compile(r"[0-9a-f]{24,}|(?:sk|pk|ghp|xox)[A-Za-z0-9_-]{16,}|(?=.*[0-9])(?=.*[A-Za-z])\S{16,}"),
    "card": re.compile(r"[3-6][0-9]{3}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}"),
    "national_id": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,}"),
}
# Gazetteers.
_GIVEN_NAMES = frozenset(
    """
    james mary john patricia robert jennifer michael linda william elizabeth david barbara
    richard susan joseph jessica thomas sarah charles karen anna peter hans maria klaus
    ursula pierre marie jean claire carlos carmen jose lucia juan sofia miguel laura
    """.split()
)
_DOMAIN_ENDS = frozenset("com org net edu gov info biz io de fr es uk eu pl it nl".split())
_IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "GB": 22, "IT": 27, "NL": 18, "PL": 28, "BE": 16, "AT": 20, "CH": 21, "PT": 25}
# Words near a span that speak for it.
_CUES = {
    "email": "email e-mail mail contact write courriel correo",
    "phone": "phone tel telephone call mobile fax cell telefon téléphone teléfono",
    "card": "card visa mastercard credit kreditkarte carte tarjeta",
    "secret": "token secret password key api login",
    "iban": "iban account konto compte cuenta bank",
    "national_id": "ssn social security sozialversicherung",
    "person": "name named contact signed dear regards",
    "address": "address live lives live street adresse dirección anschrift",
    "birth_date": "born birth birthday dob geboren né née nacido nacida",
}
_CUES = {kind: frozenset(words.split()) for kind, words in _CUES.items()}
_COUNTER = frozenset("version isbn issn order invoice page pages figure chapter price total usd eur article section vol no".split())
_WORD = re.compile(r"[^\W\d_]{2,}(?:-[^\W\d_]+)*")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by start, then kind as listed; code points."""
    out, taken = [], 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            taken = m.end()
    digit = _DIGIT.search(text) is not None
    for m in _IP.finditer(text) if digit else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text) if digit else ():
        if m.end() - m.start() < 38 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


class Candidate(NamedTuple):
    kind: str
    start: int
    end: int
    votes: str  # one of + 0 - for each labeler
    surface: str  # length, digit share and separators in few steps


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[Candidate]:
    """Further spans with the votes of the labelers; none overlaps a base span."""
    digit = _DIGIT.search(text) is not None
    found = [("email", *span) for span in _hidden_emails(text)] + [("secret", *span) for span in _secrets(text)]
    for kind, pattern in _CANDIDATES.items():
        if (digit or kind not in _WITH_DIGITS) and (kind not in _NEEDS or _NEEDS[kind].search(text)):
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    for m in _CARD.finditer(text) if digit else ():
        if m.end() - m.start() < 38 and 13 <= len(_digits(m.group())) <= 19:
            found.append(("card", *m.span()))
    if not found:
        return []
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    # base spans that overlap as one, so that starts and ends both ascend
    out, starts, ends = [], [], []
    for s, e in sorted((s, e) for _, s, e in taken):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for kind, start, end in found:
        at = bisect_right(ends, start)
        if at == len(starts) or starts[at] >= end:
            out.append(Candidate(kind, start, end, _votes(text, kind, start, end), _surface(text[start:end])))
    return out


def _votes(text: str, kind: str, start: int, end: int) -> str:
    span, digits = text[start:end], _digits(text[start:end])
    words = [w.lower() for w in _WORD.findall(span)]
    near = {w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])} | {w.lower() for w in _WORD.findall(text[end : end + 20])}
    shape = kind not in _STRICT or _STRICT[kind].fullmatch(span) is not None
    check = "0"
    if kind == "card":
        check = "+" if luhn(digits) else "-"
    elif kind == "iban":
        code = span.replace(" ", "")
        number = "".join(str(int(c, 36)) for c in code[4:] + code[:4])
        check = "+" if _IBAN_LENGTHS.get(code[:2], len(code)) == len(code) and int(number) % 97 == 1 else "-"
    elif kind == "national_id":
        check = "-" if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else "+"
    elif kind == "secret":
        check = "+" if len(set(span)) >= 10 else "-" if len(set(span)) <= 5 else "0"
    elif kind == "birth_date":
        parts = sorted(map(int, re.findall("[0-9]+", span)))
        check = "+" if 1 <= parts[0] <= 12 and 1 <= parts[1] <= 31 and 1900 <= parts[2] <= 2030 else "-"
    elif kind == "phone":
        check = "+" if 9 <= len(digits) <= 12 and len(set(digits)) > 3 else "-"
    elif kind == "email":
        check = "+" if re.search(r"[(\[{]at|dot", span, re.I) else "-"
    listed = "0"
    if kind == "person":
        listed = "+" if any(w in _GIVEN_NAMES for w in words) else "0"
    elif kind == "email":
        listed = "+" if words and words[-1] in _DOMAIN_ENDS else "-"
    elif kind == "iban":
        listed = "+" if span[:2] in _IBAN_LENGTHS else "-"
    cue = bool(near & _CUES[kind])
    counter = bool(near & _COUNTER) or text[max(0, start - 2) : start].strip()[-1:] in ("$", "€", "£", "#")
    left, right = text[start - 1 : start], text[end : end + 1]
    border = not (left.isalnum() or right.isalnum())
    return f"{'+' if shape else '0'}{check}{listed}{'+' if cue else '0'}{'-' if counter else '0'}{'+' if border else '-'}"


def _surface(span: str) -> str:
    digits = sum("0" <= c <= "9" for c in span) / len(span)
    separators = sum(c in " .-/()" for c in span)
    return f"{min(5, len(span) // 8)}{min(3, int(4 * digits))}{min(3, separators)}"


def estimate(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray]:
    """Posterior of each vote pattern, and the labelers' reliabilities, by EM.

    ``patterns`` counts the vote strings of one kind. Votes are independent given the truth;
    a Dirichlet prior holds that a vote for a span is likelier on a true one.
    """
    votes = np.array([["+0-".index(c) for c in p] for p in patterns])
    count = np.array(list(patterns.values()), dtype=float)
    one_hot = np.eye(3)[votes]  # pattern x labeler x vote
    prior = np.array([[1.0, 2.0, 4.0], [4.0, 2.0, 1.0]])  # false, true
    post = np.clip(0.5 + 0.15 * (one_hot[:, :, 0] - one_hot[:, :, 2]).sum(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        share = np.stack([1 - post, post]) * count
        table = np.einsum("cp,plv->clv", share, one_hot) + prior[:, None, :]
        table /= table.sum(axis=2, keepdims=True)
        rate = (share.sum(axis=1) + 1) / (count.sum() + 2)
        like = np.log(rate)[:, None] + np.einsum("plv,clv->cp", one_hot, np.log(table))
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(patterns, post.tolist())), table


def _features(kind: str, votes: str, surface: str) -> list[float]:
    out = [0.0] * (len(KINDS) + 2 * len(LABELERS) + 3)
    out[KINDS.index(kind)] = 1.0
    for i, c in enumerate(votes):
        if c != "0":
            out[len(KINDS) + 2 * i + (c == "-")] = 1.0
    out[-3:] = [int(c) / 5 for c in surface]
    return out


class Model(NamedTuple):
    coefficients: list[float]

    def accepts(self, kind: str, votes: str, surface: str) -> bool:
        x = _features(kind, votes, surface)
        return sum(a * b for a, b in zip(x, self.coefficients)) + self.coefficients[-1] >= 0


def train(patterns: list[tuple[str, str, str, int]]) -> Model | None:
    """Classifier from the counts of (kind, votes, surface) over all spans of the corpus."""
    by_kind: dict[str, dict[str, int]] = {}
    for kind, votes, _, n in patterns:
        votes_of = by_kind.setdefault(kind, {})
        votes_of[votes] = votes_of.get(votes, 0) + n
    if not patterns:
        return None
    post = {kind: estimate(counts)[0] for kind, counts in by_kind.items()}
    x = np.array([_features(k, v, s) for k, v, s, _ in patterns])
    y = np.array([post[k][v] for k, v, _, _ in patterns])
    # a pattern weighs by the root of its count: frequent ones do not drown the others
    return Model(fit_logistic(x, y, np.sqrt(np.array([n for *_, n in patterns], dtype=float)), ridge=0.1).tolist())


_CANDIDATE = "array<struct<kind string, start int, stop int, votes string, surface string>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, found): base spans and candidate spans of every whole text, written once."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, found = [], []
        for text in batch.column(1).to_pylist():
            spans = base_spans(text or "")
            base.append([f"{k}:{s}:{e}" for k, s, e in spans])
            found.append([dict(kind=c.kind, start=c.start, stop=c.end, votes=c.votes, surface=c.surface) for c in candidates(text or "", spans)])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("votes", pa.string()), ("surface", pa.string())]))
        return pa.record_batch([batch.column(0), pa.array(base, pa.list_(pa.string())), pa.array(found, kind)], [id_col, "base", "found"])

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, base array<string>, found {_CANDIDATE}"
    return materialise(in_batches(docs.select(id_col, text_col), kernel, schema), "personal-data")


def fit(scanned: DataFrame) -> Model | None:
    """Model from the vote patterns of all candidates. There are at most 3^6 votes, ten kinds
    and 96 surfaces, whatever the size of the corpus, and a few hundred in practice."""
    rows = (
        scanned.select(F.explode("found").alias("c"))
        .groupBy("c.kind", "c.votes", "c.surface")
        .count()
        .orderBy("kind", "votes", "surface")
        .collect()
    )
    return train([tuple(r) for r in rows])


def merge(base: list[str], found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and the accepted ones that do not overlap an earlier accepted one."""
    out = [(k, int(s), int(e)) for k, s, e in (b.split(":") for b in base)]
    end = -1
    for kind, start, stop in sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))):
        if start >= end:
            out.append((kind, start, stop))
            end = stop
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base array<string>, spans array<string>) of every row; entries are kind:start:end.

    Other columns are not read. A null text counts as empty; texts without personal data
    have empty arrays; repeated rows give repeated results. An empty table gives none.
    """
    scanned = scan(docs, id_col, text_col)
    model = fit(scanned)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for base, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            kept = [(c["kind"], c["start"], c["stop"]) for c in found if model and model.accepts(c["kind"], c["votes"], c["surface"])]
            out.append([f"{k}:{s}:{e}" for k, s, e in merge(base, kept)])
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], [id_col, "base", "spans"])

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, base array<string>, spans array<string>"
    return in_batches(scanned, kernel, schema)


def redact_text(text: str, found: list[tuple[str, int, int]]) -> str:
    """Text with every span (overlapping ones together) replaced by the first one's kind."""
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns, personal data in ``text`` replaced, ``n_chars`` anew."""
    model = fit(scan(docs))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        texts = []
        for text in batch.column(at).to_pylist():
            if text:
                base = base_spans(text)
                kept = [(c.kind, c.start, c.end) for c in candidates(text, base) if model and model.accepts(c.kind, c.votes, c.surface)]
                text = redact_text(text, merge([f"{k}:{s}:{e}" for k, s, e in base], kept))
            texts.append(text)
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = in_batches(docs, kernel, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
