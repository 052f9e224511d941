"""Three old databases of customers, orders and items into one: keys, references, and what the comparison says of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import migration as M
from quarryline.plans.registration import plan
from quarryline.session import shared_dir, table, write_through

#: An old database has its own ids; accounts of one nation and segment with the same whole balance are one person.
_OLD = """
owners AS (SELECT CAST(c_custkey % 3 AS INT) AS db, c_custkey // 3 AS own, c_nationkey AS nation, c_mktsegment AS segment, CAST(FLOOR(c_acctbal) AS BIGINT) AS balance, c_acctbal < 0 AS skipped FROM customer),
posts AS (SELECT CAST(o_custkey % 3 AS INT) AS db, o_orderkey AS own, o_custkey // 3 AS owner, o_totalprice AS views FROM orders),
items AS (SELECT CAST(o_custkey % 3 AS INT) AS db, l_orderkey AS post, l_linenumber AS line, l_quantity AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
persons AS (SELECT nation, segment, balance, MIN((db, own)) AS kept FROM owners WHERE NOT skipped GROUP BY ALL),
people AS (SELECT o.db, o.own, p.kept, p.kept = (o.db, o.own) AS first FROM owners o JOIN persons p ON p.nation = o.nation AND p.segment = o.segment AND p.balance = o.balance WHERE NOT o.skipped),
ids AS (SELECT db, own, ROW_NUMBER() OVER (ORDER BY db, own) AS id FROM people WHERE first),
owner_ids AS (SELECT p.db, p.own, i.id FROM people p JOIN ids i ON i.db = p.kept[1] AND i.own = p.kept[2]),
post_ids AS (SELECT db, own, owner_id, views, ROW_NUMBER() OVER (ORDER BY db, own) AS id FROM (SELECT p.db, p.own, o.id AS owner_id, p.views FROM posts p JOIN owner_ids o ON o.db = p.db AND o.own = p.owner))"""


def _old(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    split = lambda c: ((F.col(c) % 3).cast("int"), F.floor(F.col(c) / 3))
    c, o, i = (table(spark, d, t) for t in ("customer", "orders", "lineitem"))
    db, own = split("c_custkey")
    owners = c.select(db.alias("db"), own.alias("own"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.floor("c_acctbal").alias("balance"), (F.col("c_acctbal") < 0).alias("skipped"))
    db, own = split("o_custkey")
    posts = o.select(db.alias("db"), F.col("o_orderkey").alias("own"), own.alias("owner"), F.col("o_totalprice").alias("views"))
    items = i.join(posts.select("db", F.col("own").alias("l_orderkey")), "l_orderkey").select("db", F.col("l_orderkey").alias("post"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("weight"))
    return owners, posts, items


def _merged(owners: DataFrame) -> DataFrame:
    """Accounts that are not skipped, each with the first account of its person."""
    kept = owners.filter("NOT skipped")
    same = ["nation", "segment", "balance"]
    persons = kept.groupBy(*same).agg(F.min(F.struct("db", "own")).alias("kept"))
    return kept.join(persons, same).select("db", "own", "kept", (F.struct("db", "own") == F.col("kept")).alias("first"))


def _owner_ids(people: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The new id of every old account, merged ones with that of their person."""
    ids = M.new_keys(people.filter("first"), ["db", "own"], known)
    mapped = people.select("db", "own", F.col("kept.db").alias("__db"), F.col("kept.own").alias("__own"))
    return mapped.join(ids.select(F.col("db").alias("__db"), F.col("own").alias("__own"), "id"), ["__db", "__own"]).select("db", "own", "id")


def _migrated(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    owners, posts, items = _old(spark, d)
    people = write_through(_merged(owners), shared_dir(spark))
    owner_ids = write_through(_owner_ids(people), shared_dir(spark))
    good_posts, lost_posts = M.remap(posts, {"owner_id": ({"db": "db", "owner": "own"}, owner_ids)})
    post_ids = write_through(M.new_keys(good_posts, ["db", "own"]), shared_dir(spark))
    good_items, lost_items = M.remap(items, {"post_id": ({"db": "db", "post": "own"}, post_ids)})
    return {"owners": owners, "posts": posts, "items": items, "people": people, "owner_ids": owner_ids, "good_posts": good_posts.join(post_ids, ["db", "own"]), "lost_posts": lost_posts, "good_items": good_items, "lost_items": lost_items}


@plan(f"WITH {_OLD} SELECT id, owner_id, db, own, views FROM post_ids")
def migrated_posts(spark, d):
    """Posts under new keys, their owners followed into the merged accounts."""
    return _migrated(spark, d)["good_posts"].select("id", "owner_id", "db", "own", "views")


@plan(f"""WITH {_OLD} SELECT 'posts' AS table_name, 'owner_id' AS missing, COUNT(*) AS n FROM posts p WHERE NOT EXISTS (SELECT 1 FROM owner_ids o WHERE o.db = p.db AND o.own = p.owner)
UNION ALL SELECT 'items', 'post_id', COUNT(*) FROM items i WHERE NOT EXISTS (SELECT 1 FROM post_ids p WHERE p.db = i.db AND p.own = i.post)""")
def migration_rejects(spark, d):
    """Rows without a parent, down to the children of rejected rows."""
    m = _migrated(spark, d)
    both = m["lost_posts"].select(F.lit("posts").alias("table_name"), "missing").unionByName(m["lost_items"].select(F.lit("items").alias("table_name"), "missing"))
    return both.groupBy("table_name", "missing").agg(F.count("*").alias("n"))


@plan(f"""WITH {_OLD}, early AS (SELECT db, own, ROW_NUMBER() OVER (ORDER BY db, own) AS id FROM people WHERE first AND own % 2 = 0)
SELECT db, own, id FROM early UNION ALL SELECT db, own, (SELECT MAX(id) FROM early) + ROW_NUMBER() OVER (ORDER BY db, own) FROM people WHERE first AND own % 2 <> 0""")
def migrated_again(spark, d):
    """The same accounts migrated after a first half was: known keys keep their ids, and a third run changes nothing."""
    people = _merged(_old(spark, d)[0]).filter("first")
    early = write_through(M.new_keys(people.filter("own % 2 = 0"), ["db", "own"]), shared_dir(spark))
    both = write_through(M.new_keys(people, ["db", "own"], early), shared_dir(spark))
    return M.new_keys(people, ["db", "own"], both)


@plan(f"""WITH {_OLD}, rows AS (
  SELECT 'owners' AS rule, CASE WHEN o.skipped THEN 'skipped' WHEN p.first THEN 'matched' ELSE 'merged' END AS cause FROM owners o LEFT JOIN people p USING (db, own)
  UNION ALL SELECT 'posts', CASE WHEN q.id IS NULL THEN 'orphan' WHEN p.own % 101 = 0 THEN 'unexplained' WHEN p.own % 97 = 0 THEN 'changed' ELSE 'matched' END FROM posts p LEFT JOIN post_ids q USING (db, own)
  UNION ALL SELECT 'posts', 'added' FROM post_ids WHERE own % 89 = 0
  UNION ALL SELECT 'items', CASE WHEN q.id IS NULL THEN 'orphan' ELSE 'matched' END FROM (SELECT DISTINCT db, post, line FROM items) i LEFT JOIN post_ids q ON q.db = i.db AND q.own = i.post),
counted AS (SELECT rule, cause, COUNT(*) AS n FROM rows GROUP BY 1, 2)
SELECT rule, cause, n, CAST(SUM(CASE WHEN cause IN ('matched', 'changed') THEN 0 WHEN cause = 'added' THEN -n ELSE n END) OVER (PARTITION BY rule) AS BIGINT) AS difference,
  SUM(CASE WHEN cause IN ('unexplained', 'added', 'changed') THEN n ELSE 0 END) OVER (PARTITION BY rule) = 0 AS explained FROM counted""")
def parity_causes(spark, d):
    """Every difference of the migration by cause; posts have planted losses, changed values and copies that nothing explains."""
    m = _migrated(spark, d)
    owners, people, posts, items = m["owners"], m["people"], m["posts"], m["items"]
    good = m["good_posts"].select("db", "own", "views")
    faulty = good.filter("own % 101 <> 0").withColumn("views", F.when(F.col("own") % 97 == 0, F.col("views") + 1).otherwise(F.col("views")))
    faulty = faulty.unionByName(good.filter("own % 89 = 0").withColumn("own", -1 - F.col("own")))
    rules = [
        M.differences("owners", owners, people.filter("first"), ["db", "own"], [("skipped", owners.filter("skipped")), ("merged", people.filter("NOT first"))]),
        M.differences("posts", posts, faulty, ["db", "own"], [("orphan", m["lost_posts"])], ["views"]),
        M.differences("items", items, m["good_items"], ["db", "post", "line"], [("orphan", m["lost_items"])]),
    ]
    return M.report(rules)
