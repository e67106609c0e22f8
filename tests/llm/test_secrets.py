import hashlib
import re

import numpy as np

from constella.llm import secrets as S

PATTERNS = {
    "assign": re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
KEY = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")


def brute(text):
    text, out = text or "", []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in p.finditer(text):
            if len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def weak(text, scope):
    text, base = text or "", brute(text)
    near = lambda a, b, c, d: 0 <= a - d <= scope or 0 <= c - b <= scope
    keys = [(m.start(), 3, m.end()) for m in KEY.finditer(text) if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    keys = [x for x in keys if not any(x[0] < e and s < x[2] for s, _, e in base) and any(k == 1 and near(x[0], x[2], s, e) for s, k, e in base)]
    ends = [(m.start(), 4, m.end()) for m in re.finditer(S.ENDPOINT, text)]
    return keys + [x for x in ends if not any(x[0] < e and s < x[2] for s, k, e in base if k) and any(near(x[0], x[2], s, e) for s, _, e in base + keys)]


def check(spark, texts, scope=S.SCOPE):
    table = spark.createDataFrame([(k % 7 if k % 5 else None, t, "n") for k, t in enumerate(texts)], "doc_id long, text string, row string")
    got = sorted(([(s.start, S.KINDS.index(s.kind), s.end) for s in r.spans], r.n_assign, r.n_access, r.n_hex, r.n_linked) for r in S.scan(table, scope=scope).collect())
    want = []
    for t in texts:
        base, more = brute(t), weak(t, scope)
        want.append((sorted(base + more), *(sum(k == j for _, k, _ in base) for j in range(3)), len(more)))
    assert got == sorted(want)


def test_edges(spark):
    access, key, token = "AKIA" + "A1" * 8, "aB3/" * 10, "0123456789abcdef01234567"
    check(spark, [None, "", "é😀 token=token:abcdef x", "PassWord' := abc", "api_key:\"a.b=c-\"", f"{access} {key}", f"{access}{' ' * 401}{key}", f"{access}{' ' * 400}{key}", key, f"x{token} {token}g", "AKIAAKIA" + "B" * 15, "secret = " + token, f"{access} https://db.example.org/x?a=1", "https://example.org only", f"{access}/{key}", f"😀 passwd=abcdef {'y ' * 100} arn:aws:s3:::bucket/{'z' * 900} {access}", "token=abcdef " * 300, "AKIA", "tokenſ=abcdef", "toKen=abcdef"])


def test_random_texts(spark):
    r = np.random.default_rng(3)
    bits = ["token", "=", " ", '"', "abc123", "AKIA", "Q7" * 9, "0a" * 13, ":", "aB3+" * 10, "https://h.example/p", "é", "secret", "\n", "api_key"]
    check(spark, ["".join(r.choice(bits, int(r.integers(0, 60)))) for _ in range(80)], 30)


def test_digest_and_empty_table(spark):
    assert S.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = S.query(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        line = ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in brute(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()


def test_sql_finds_the_same():
    duckdb = __import__("pytest").importorskip("duckdb")
    r = np.random.default_rng(5)
    bits = ["token", "=", " ", '"', "abc123", "AKIA", "Q7" * 9, "0a" * 13, ":", "aB3+" * 10, "https://h.example/p", "é", "secret", "\n", "api_key", "y " * 120]
    texts = [None, "", *["".join(r.choice(bits, int(r.integers(0, 60)))) for _ in range(150)]]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    rows = con.sql(S.ORACLE_SQL)
    got = {x[0]: dict(zip(rows.columns, x, strict=True)) for x in rows.fetchall()}
    for k, t in enumerate(texts):
        base, more = brute(t), weak(t, S.SCOPE)
        line = lambda spans: ",".join(f"{S.KINDS[j]}:{s}:{e}" for s, j, e in sorted(spans))
        assert got[k]["spans"] == line(base + more) and got[k]["n_linked"] == len(more)
        assert got[k]["base_sha256"] == hashlib.sha256(line(base).encode()).hexdigest()


def test_long_texts_and_other_columns(spark):
    filler = "no secret here " * 100_000
    docs = spark.createDataFrame([(1, f"{filler}token = abcdef123 {filler}", "x", 1), (1, "a" * 2_000_000 + " password:" + " " * 500_000, None, 2), (2, "0" * 1_000_000, "y", 3)], "doc_id long, text string, spans string, row int")
    got = sorted((r.doc_id, r.n_assign, r.n_hex) for r in S.scan(docs).collect())
    assert got == [(1, 0, 1), (1, 1, 0), (2, 0, 1)]
