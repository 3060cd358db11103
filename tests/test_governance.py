"""Row policies, tokens, merges with their log, and change feeds, against plain Python."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from calltide.operators import provenance as P
from calltide.operators import row_policies as G
from calltide.operators import tokens as K

# -- Row policies

ROLES = [(1, 10, "owner"), (2, 10, "admin"), (3, 10, "analyst"), (4, 10, "member"), (5, 10, "viewer"), (6, 20, "admin"), (7, 20, "member"), (4, 20, "viewer")]
CONTACTS = [(100, 1), (101, 2), (102, 4), (103, 4), (104, 4), (105, 7), (106, None)]
RULES = [(102, "private"), (103, "team"), (101, "private"), (105, "public"), (104, "private"), (104, "public")]


@pytest.fixture(scope="module")
def world(spark):
    roles = spark.createDataFrame(ROLES, "user_id long, org_id long, role string")
    contacts = spark.createDataFrame(CONTACTS, "id long, owner_id long")
    rules = spark.createDataFrame(RULES, "contact_id long, visibility string")
    return roles, contacts, rules, G.default_policies(spark)


def plain_secured(rows, table, requester, command="select"):
    """Rows of dicts with user_id, contact_id, role, org_id, resource, resource_id."""
    best = {}
    for u, o, r in ROLES:
        if u not in best or (G.POWER[r], -o) > (G.POWER[best[u][1]], -best[u][0]):
            best[u] = (o, r)
    org, role = best.get(requester, (None, None))
    by_contact = {}
    for c, v in RULES:
        by_contact.setdefault(c, []).append(v)

    def contact_open(c):
        owner = dict(CONTACTS).get(c, "?")
        if owner == "?" or requester is None:
            return False
        rules, (o, r) = by_contact.get(c), best.get(owner, (None, None))
        return owner == requester or (o is not None and o == org and (not rules or bool({"team", "public"} & set(rules)) or r in ("owner", "admin")))

    def holds(test, row):
        name, _, arg = test.partition(":")
        owner_org, owner_role = best.get(row["user_id"], (None, None))
        return {
            "own": lambda: requester is not None and row["user_id"] == requester, "same_org": lambda: org is not None and owner_org == org, "owner_role": lambda: owner_role in arg.split(","), "my_role": lambda: role in arg.split(","),
            "contact": lambda: row["contact_id"] is None or contact_open(row["contact_id"]), "about_me": lambda: requester is not None and row[arg] == requester, "value": lambda: row[arg.split("=")[0]] in arg.split("=")[1].split(","),
            "org_member": lambda: any(u == requester and o == row["org_id"] for u, o, _ in ROLES), "org_role": lambda: any(u == requester and o == row["org_id"] and r in arg.split(",") for u, o, r in ROLES),
            "role_not_above": lambda: role == "owner" or G.POWER.get(row["role"], 0) <= G.POWER.get(role, 0), "anyone": lambda: True, "system": lambda: requester is None,
        }[name]()

    return {row["id"] for row in rows if any(all(holds(t, row) for t in tests) for tab, _, c, tests in G.DEFAULTS if tab == table and c in (command, "all"))}


@pytest.fixture(scope="module")
def rows(spark):
    out, i = [], 0
    for user in [*range(1, 8), 99, None]:
        for contact in [None, *range(100, 107), 999]:
            i += 1
            out.append({"id": i, "user_id": user, "contact_id": contact, "role": ["viewer", "admin", "owner", "analyst"][i % 4], "org_id": [10, 20, 30, None][i % 4], "resource": ["user", "contact", "event", "other", None][i % 5], "resource_id": i % 8})
    df = spark.createDataFrame([tuple(r.values()) for r in out], "id long, user_id long, contact_id long, role string, org_id long, resource string, resource_id long")
    return out, df.withColumn("visibility", F.lit(1))


@pytest.mark.parametrize("table", sorted({t for t, *_ in G.DEFAULTS}))
def test_policies_of_every_table(spark, world, rows, table):
    plain, df = rows
    roles, contacts, rules, policies = world
    for requester in (1, 3, 4, 7, 99, None):
        for command in ("select", "insert", "update", "delete") if table in ("org_roles", "incidents", "billing_subscriptions", "outbox") else ("select",):
            got = G.secured(df, table, policies, roles, requester, command, contacts=contacts, rules=rules)
            assert got.columns == df.columns
            assert {r["id"] for r in got.select("id").collect()} == plain_secured(plain, table, requester, command), (table, requester, command)


def test_tables_without_policies_and_tests_without_names(spark, world, rows):
    roles, contacts, rules, policies = world
    assert G.secured(rows[1], "secrets", policies, roles, 1).count() == 0
    own = spark.createDataFrame([("x", "p", "select", ["magic"])], G.POLICIES)
    with pytest.raises(ValueError, match="magic"):
        G.secured(rows[1], "x", own, roles, 1)
    everyone = spark.createDataFrame([("x", "p", "select", [])], G.POLICIES)
    assert G.secured(rows[1], "x", everyone, roles, 1).count() == len(rows[0])


# -- Tokens


def test_tokens_from_hashes(spark):
    values = ["+15551234567", "", "ÄÖ😀", None]
    v = F.col("v")
    got = spark.createDataFrame([(x,) for x in values], "v string").select("v", K.numeric(v).alias("n"), K.alphanumeric(v).alias("a"), K.alphanumeric(v, 32, False).alias("b"), K.hashed(v, 20).alias("h"), K.dressed(K.hashed(v), "<", ">", True).alias("d")).collect()
    for r in got:
        if r["v"] is None:
            assert tuple(r)[1:] == (None,) * 5
            continue
        h = hashlib.sha256(r["v"].encode()).digest()
        assert r["n"] == "".join(str(b % 10) for b in h[:10]) and r["a"] == "".join(K.ALPHANUMERIC[b % 62] for b in h[:8])
        assert r["b"] == "".join(K.ALPHANUMERIC[b % 62] for b in h).lower() and r["h"] == h.hex()[:20]
        body = f"<{h.hex()[:16]}>"
        assert r["d"] == body + hashlib.md5(body.encode()).hexdigest()[:4]
    assert all(r[0] for r in spark.createDataFrame([(r["d"],) for r in got if r["d"]], "d string").select(K.checksum_holds(F.col("d"))).collect())
    with pytest.raises(ValueError):
        K.numeric(v, 33)


@pytest.mark.parametrize(("length", "base"), [(1, 10), (2, 10), (3, 10), (4, 10), (1, 26), (2, 26), (3, 5)])
def test_feistel_is_a_permutation_with_an_inverse(length, base):
    for key in (b"a", b"another"):
        seen = [K.permuted(n, length, base, key, "t") for n in range(base**length)]
        assert sorted(seen) == list(range(base**length))
        assert [K.permuted(n, length, base, key, "t", back=True) for n in seen] == list(range(base**length))
    assert seen != [K.permuted(n, length, base, b"a", "t") for n in range(base**length)]


def test_format_preserving_tokens(spark):
    values = ["+1 (555) 123-4567", "Ann.Smith@Example.com", "", None, "---", "7", "Äb9", "0000000000", "٣٤ x", "4111 1111 1111 1111"]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "id int, v string, other string").repartition(2)
    t = K.format_preserving(df, {"v": "t"}, b"key")
    back = K.format_preserving(t, {"t": "b"}, b"key", back=True).collect()
    for r in back:
        assert r["b"] == r["v"] and r["other"] == "x"
        if r["v"]:
            kind = lambda s: ["0" if c in "0123456789" else "A" if c.isascii() and c.isupper() else "a" if c.isascii() and c.islower() else c for c in s]
            assert kind(r["t"]) == kind(r["v"])
    by = {r["v"]: r["t"] for r in back}
    assert by["4111 1111 1111 1111"] != "4111 1111 1111 1111" and by["---"] == "---"
    assert {r["t"] for r in K.format_preserving(df, {"v": "t"}, b"key", tweak="z").collect() if r["v"] and len(r["v"]) > 5} & set(by.values()) == set()
    numbers = spark.range(2000).select(F.format_string("%04d", "id").alias("v"))
    assert K.format_preserving(numbers, {"v": "t"}, b"key").select("t").distinct().count() == 2000
    with pytest.raises(ValueError):
        K.format_preserving(df, {"v": "other"}, b"key")


def test_encrypted_tokens(spark):
    key = "0123456789abcdef0123456789abcdef"
    df = spark.createDataFrame([("secret ä",), ("",), (None,)], "v string").select("v", K.encrypted(F.col("v"), key, "k1").alias("t"))
    df = spark.createDataFrame(df.collect(), "v string, t string")
    got = df.select("v", "t", K.decrypted(F.col("t"), key).alias("d"), K.decrypted(F.col("t"), key[::-1]).alias("w"), K.decrypted(F.concat(F.lit("k1:00"), F.substring("t", 6, 500)), key).alias("x")).collect()
    for r in got:
        assert r["d"] == r["v"] and r["w"] is None and r["x"] is None
        if r["v"] is not None:
            parts = r["t"].split(":")
            assert parts[0] == "k1" and [len(parts[1]), len(parts[3])] == [24, 32] and len(parts[2]) == 2 * len(r["v"].encode())


# -- Merges and changes

EVENT = "k string, id long, ts long, type string, duration int, content string, note string"


def test_merges_with_their_log(spark):
    rows = [
        ("a", 1, 5, "call", 10, "hi", None), ("a", 2, 4, "sms", 30, "hello", "n"), ("a", 3, 6, "sms", None, "HELLO", "n"), ("a", 4, None, "call", 20, None, "n"),
        ("b", 5, 1, "call", None, None, None), (None, 6, 1, "call", 1, "x", "p"), (None, 7, 2, "call", 1, "x", "q"),
    ]
    df = spark.createDataFrame(rows, EVENT).repartition(3)
    merged, log = P.merge_with_log(df, ["k"], P.EVENT_RULES | {"note": "last"})
    got = {r["k"]: tuple(r)[1:] for r in merged.collect()}
    assert merged.columns == ["k", "id", "ts", "type", "duration", "content", "note", "merged", "conflicts"]
    assert got["a"] == (4, 4, "call", 30, "hello", "n", 4, ["ts", "type", "duration", "content"]) and got["b"] == (5, 1, "call", None, None, None, 1, [])
    assert got[None] == (6, 1, "call", 1, "x", "q", 2, ["ts", "note"])
    entries = {(r["k"], r["field"], r["id"]): (r["rule"], r["value"], r["kept"], r["kept_id"]) for r in log.collect()}
    assert entries[("a", "content", 2)] == ("longest", "hello", True, 4) and entries[("a", "content", 3)] == ("longest", "HELLO", False, 4) and ("a", "content", 4) not in entries
    assert entries[("a", "duration", 2)] == ("max", "30", True, 4) and ("a", "duration", 3) not in entries and ("a", "note", 2) not in entries
    assert entries[(None, "note", 7)] == ("last", "q", True, 6) and entries[(None, "note", 6)] == ("last", "p", False, 6)
    assert not [k for k in entries if k[0] == "b"]
    for rule, want in (("shortest", "hi"), ("min", "HELLO"), ("manual", "hello"), ("first", "hello"), ("last", "HELLO")):
        assert {r["k"]: r["content"] for r in P.merge_with_log(df, ["k"], {"content": rule})[0].collect()}["a"] == want, rule
    with pytest.raises(ValueError):
        P.merge_with_log(df, ["k"], {"content": "best"})
    assert P.merge_with_log(df.limit(0), ["k"], {})[1].count() == 0


def test_feeds_of_changes(spark):
    before = spark.createDataFrame([(1, "a", 5, None), (2, "b", 6, "x"), (3, "c", 7, "y"), (None, "d", 8, "z"), (5, None, None, None)], "k int, v string, n int, gone string")
    after = spark.createDataFrame([(1, "a", 5), (2, "B", 6), (4, "e", 9), (None, "d", None), (5, None, None)], "k int, v string, n int").withColumn("made", F.when(F.col("k") == 1, "m"))
    got = {r["k"]: (r["action"], r["old"], r["new"]) for r in P.changes(before, after, ["k"]).collect()}
    assert got == {
        1: ("update", {"made": None}, {"made": "m"}), 2: ("update", {"v": "b", "gone": "x"}, {"v": "B", "gone": None}), 3: ("delete", {"v": "c", "n": "7", "gone": "y", "made": None}, None), 4: ("insert", None, {"v": "e", "n": "9", "gone": None, "made": None}),
        None: ("update", {"n": "8", "gone": "z"}, {"n": None, "gone": None}),
    }
    assert P.changes(before, before, ["k"]).count() == 0


def test_audits_of_changes_chain(spark):
    before = spark.range(200).selectExpr("id AS k", "'a' AS v")
    after = spark.range(50, 250).selectExpr("id AS k", "if(id % 2 = 0, 'b', 'a') AS v")
    entries = P.change_audit(before, after, ["k"], "thing", F.col("k") % 3).collect()
    assert len(entries) == 50 + 50 + 75
    chains = {}
    for r in sorted(entries, key=lambda r: (r["actor_id"], r["seq"])):
        assert r["previous_hash"] == chains.get(r["actor_id"], "")
        chains[r["actor_id"]] = hashlib.sha256(f"{r['previous_hash']}|{r['body']}".encode()).hexdigest()
        assert r["checksum"] == chains[r["actor_id"]]
        body = json.loads(r["body"])
        k = json.loads(body["key"])["k"]
        assert body["action"] == ("delete" if k < 50 else "insert" if k >= 200 else "update") and r["actor_id"] == k % 3
    again = P.change_audit(before.repartition(5), after.repartition(7), ["k"], "thing", F.col("k") % 3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, entries))
    assert len({r["actor_id"] for r in P.change_audit(before, after, ["k"], "thing").select("actor_id").collect()}) > 30
