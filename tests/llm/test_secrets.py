import hashlib
import re

from pyspark.sql import functions as F

from braidwork.llm import secrets
from helpers import rows_of

KEY = r"[A-Za-z0-9+/_.=-]"
AWS, HEX = "AKIA" + "ABCDEFGH12345678", "deadbeef" * 4
LIVE = "Zk3" + "pQ9xLm2Vt8Rw5Yb7Nc1Df"


def base(text):
    text = text or ""
    kw = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey"))
    found = [("assign", m.start(), m.end()) for m in re.finditer(rf"""({kw})["']?\x20*[:=]\x20*["']?({KEY}+)""", text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def scan(df):
    return secrets.scan_secrets(df, owner=F.col("source"), repo=F.col("doc_id"))


def test_base_spans(frame, odd_texts):
    texts = odd_texts + [
        f"x password = 'hunter22' {AWS} y {HEX}", f"TOKEN:{HEX}", "secret = token : abcdefgh", "api_key=\"ab\" apikey : zzzzzz", "é😀 passwd=secret=123456", "ſecret=abcdefgh toKen=abcdefgh",
        "password password=abcdef", "AKIA123 AKIA" + "Z" * 30, "0123456789abcdef0123456", HEX + HEX.upper(), "pass\nword=abcdef token\t=abcdef", "token==abcdef",
    ]
    got = {r.doc_id: r for r in scan(frame(rows_of(texts))).collect()}
    for i, t in enumerate(texts):
        want = base(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest(), t
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == n for k, *_ in want) for n in ("assign", "access", "hex")]


def test_ownership_adds_live_spans_only(frame):
    rows = [(i, f"use {AWS} here", "en", f"s{i}", 1, "x", 1) for i in range(4)] + [(9, f"mine {LIVE} end", "en", "s9", 1, "x", 1), (10, "shared Aa1Bb2Cc3Dd4Ee5Ff6Gg7 x", "en", "a", 1, "x", 1), (11, "shared Aa1Bb2Cc3Dd4Ee5Ff6Gg7 x", "en", "b", 1, "x", 1)]
    got = {r.doc_id: r for r in scan(frame(rows)).collect()}
    assert got[0].n_example == 1 and got[0].spans == "access:4:24"
    assert got[9].spans == f"live:5:{5 + len(LIVE)}" and got[9].n_owner_specific == 1
    assert got[10].spans == "" and got[11].spans == ""


def test_repeats_nulls_and_redaction(frame):
    rows = [(1, f"a {HEX} b token=abcdefgh {HEX}", "en", None, 1, "x", 1)] * 2 + [(2, None, None, None, None, None, None), (None, f"k {HEX}", "en", "q", 1, "x", 1), (1, "clean", "en", "q", 1, "x", 1)]
    got = scan(frame(rows)).collect()
    assert len(got) == 5 and sorted(r.n_hex for r in got) == [0, 0, 1, 2, 2]
    out = secrets.redacted(frame(rows), F.col("source"), F.col("doc_id"))
    assert out.columns == frame(rows).columns
    assert sorted(str(r.text) for r in out.collect()) == sorted(["a [secret] b [secret] [secret]"] * 2 + ["None", "k [secret]", "clean"])


def test_overlapping_spans_are_one_cut(frame):
    rows = [(1, f"token={HEX} end", "en", "s", 1, "x", 1)]
    assert secrets.redacted(frame(rows), F.col("source"), F.col("doc_id")).first().text == "[secret] end"


def test_empty_table(frame):
    assert scan(frame([])).collect() == []
