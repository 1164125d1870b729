from datetime import datetime

from pyspark.sql import functions as F

from shoprank.llm import url_lists

DAY = {k: datetime(2024, 1, k) for k in range(1, 29)}
ENTRIES = [("bad.com", "spam", "add", DAY[3]), ("bad.com", "spam", "remove", DAY[10]), ("bad.com", "spam", "add", DAY[20]), ("bad.com", "ads", "add", DAY[5]),
           ("ok.org/shop", "ads", "add", DAY[2]), ("COM", None, "add", DAY[27]), ("x.net", "spam", "add", DAY[4]), ("x.net", "spam", "remove", DAY[4]),
           (None, "spam", "add", DAY[1]), ("y.net", "spam", None, DAY[1]), ("y.net", "spam", "add", None), ("bad.com", "spam", "add", DAY[3])]
URLS = ["http://BAD.com/a", "https://user@www.bad.com:80/x?y#z", "http://notbad.com", "https://ok.org/Shop/1", "https://ok.org/shops", "http://x.net/", "", None, "nonsense", "ftp://y.net"]


def host(u):
    u = (u or "").lower()
    if "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1].split("?")[0].split("#")[0]
    name, _, path = rest.partition("/")
    return name.split("@")[-1].split(":")[0], path.split("/")[0]


def brute(url, at):
    name, section = host(url)
    parts = name.split(".")
    keys = {".".join(parts[k:]) for k in range(len(parts))} | ({f"{name}/{section}"} if section else set())
    active = []
    for p, c in {(e[0].lower(), e[1] or "") for e in ENTRIES if e[0]}:
        own = sorted({(e[3], e[2]) for e in ENTRIES if e[0] and e[0].lower() == p and (e[1] or "") == c and e[2] and e[3] and e[3] <= at}) if at else []
        if name and p in keys and own and own[-1][1] == "add":
            active.append((c, own[-1][0]))
    return sorted({c for c, _ in active}), min((d for _, d in active), default=None), bool(active)


def test_captures_equal_a_replay_of_the_list(spark):
    entries = spark.createDataFrame(ENTRIES, "pattern string, category string, action string, listed timestamp")
    rows = [(k, u, d) for k, u in enumerate(URLS) for d in [*DAY.values(), None]] * 2
    captures = spark.createDataFrame(rows, "id int, url string, fetched timestamp").withColumns({c: F.lit("own") for c in ("pattern", "valid_from", "since", "blocked", "host", "__host", "__SECTION", "__fetched", "__fetched_")})
    got = url_lists.judge(captures, entries)
    assert got.count() == len(rows) and {"id", "pattern", "valid_from", "host", "__host", "__SECTION", "__fetched", "__fetched_"} <= set(got.columns)
    assert {tuple(r) for r in got.select("__host", "__SECTION", "__fetched", "__fetched_").distinct().collect()} == {("own",) * 4}
    for r in got.collect():
        assert (r["categories"], r["since"], r["blocked"]) == brute(r["url"], r["fetched"]), r


def test_empty_tables_and_native_plan(spark):
    entries = spark.createDataFrame([], "pattern string, category string, action string, listed int")
    captures = spark.createDataFrame([("http://a.b/", 3)], "url string, fetched int")
    out = url_lists.judge(captures, entries)
    assert [tuple(r) for r in out.collect()] == [("http://a.b/", 3, [], None, False)]
    assert url_lists.judge(captures.limit(0), entries).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan
