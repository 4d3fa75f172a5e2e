import hashlib
import re

from hypothesis import given, settings, strategies as st

from textlab.llm import personal as P
from textlab.llm.registry import op2_personal_data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            odd = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and odd % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0])))


pieces = st.sampled_from(["1", "0", "25", ".", "..", "@", "+", "-", " ", "a", "é", "%", "(", "4111111111111111", "a@b.c", "1.2.3.4", "4111 1111-1111 1111", "+48 22 123 45 67", "\n"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(pieces, max_size=14).map("".join))
def test_base_spans(text):
    assert P.base_spans(text) == brute(text)


def test_long_runs_stay_linear():
    for text in ("9" * 300_000, "a" * 300_000, "1." * 150_000, "+" * 300_000, "a." * 150_000 + "@", "1 " * 150_000):
        P.candidates(text, P.base_spans(text))


def test_em_finds_the_reliable_labeler():
    post, table = P.estimate({"++0000": 50, "+-0000": 2, "0-0000": 60, "0+0000": 3, "00000-": 5})
    assert post["++0000"] > 0.9 > 0.1 > post["0-0000"]
    assert table[1, 1, 0] > table[0, 1, 0]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, base string")


def test_added_spans_and_redaction(spark):
    good = "é call 555-123-4567 now, write jane.doe (at) mail dot org or a@b.org; token = \"9f86d081884c7d659a2feaa0c55ad015\"."
    rows = [(i, good, "x") for i in range(30)] + [(100 + i, f"version 12-{i} at that. Then", "x") for i in range(30)]
    got = {r["doc_id"]: r for r in P.spans(frame(spark, rows)).collect()}
    kinds = {(s.split(":")[0], good[int(s.split(":")[1]) : int(s.split(":")[2])]) for s in got[0]["spans"]}
    assert {("phone", "555-123-4567"), ("email", "a@b.org"), ("email", "jane.doe (at) mail dot org"), ("secret", "9f86d081884c7d659a2feaa0c55ad015")} == kinds
    assert got[0]["base"] == [f"email:{good.index('a@b')}:{good.index('a@b') + 7}"] and got[100]["spans"] == []
    clean = {r["doc_id"]: r for r in P.redact(frame(spark, rows).selectExpr("base", "text", "doc_id", "9 as n_chars")).collect()}
    assert clean[3]["text"] == "é call [phone] now, write [email] or [email]; token = \"[secret]\"."
    assert clean[3]["n_chars"] == len(clean[3]["text"]) and clean[101]["text"] == rows[31][1]


def test_redaction_of_overlaps():
    assert P.redact_text("abcdefgh", [("card", 1, 4), ("phone", 3, 6), ("ip", 7, 8)]) == "a[card]g[ip]"


def test_edge_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "a@b.c", "x"), (2, "", "x"), (3, "x " * 100_000 + "a@b.c", "x")]
    got = sorted(((r["doc_id"] or -1), r["base"]) for r in P.spans(frame(spark, rows)).collect())
    assert got == [(-1, ["email:0:5"]), (1, []), (1, []), (2, []), (3, ["email:200000:200005"])]
    assert P.spans(frame(spark, rows).limit(0)).count() == 0
    assert P.redact(frame(spark, rows)).where("text is null").count() == 2


def test_query(spark):
    from conftest import SMALL

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op2_personal_data(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert r["base_sha256"] == digest and [r[f"n_{k}"] for k in PLAIN] == [sum(w[0] == k for w in want) for k in PLAIN]
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(r["spans"].split(","))  | {""}


def test_short_candidate_before_a_base_span_in_a_long_one():
    text = "token=aaaa;1990-02-03;bcd,me@host.org"
    base = P.base_spans(text)
    found = [(c.kind, text[c.start : c.end]) for c in P.candidates(text, base)]
    assert [text[s:e] for _, s, e in base] == ["me@host.org"] and found == [("phone", "1990-02-03"), ("birth_date", "1990-02-03")]


def test_secrets_go_whole(spark):
    secrets = ["k9" * 250, "aB3" * 400 + "=x", "0123456789abcdef" * 70]
    rows = [(i, f"login: api_key={s} end", "x") for i, s in enumerate(secrets * 15)] + [(100 + i, f"version 12-{i} at that", "x") for i in range(30)]
    for r in P.redact(frame(spark, rows).selectExpr("doc_id", "text")).where("doc_id < 100").collect():
        assert r["text"] == "login: api_key=[secret] end"
    # a run of signs is read once
    assert len(list(P._secrets("key=" * 100_000))) == 1


def test_long_hidden_addresses():
    text = f"{'a' * 60}.b at {'c' * 62} dot d dot e dot f dot g dot h dot org"
    assert list(P._hidden_emails(text)) == [(0, len(text))]
