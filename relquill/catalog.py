"""The query catalogue over the star-schema tables, with the same questions in SQL."""

from __future__ import annotations

import dataclasses
import datetime as dt
import enum
import itertools
import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relquill.engine import Engine
from relquill.functions.values import Converter, TypeHandler, enum_names, register_type
from relquill.plans.schema import Entity, Field, InverseOne, ManyToMany, ToMany, ToOne
from relquill.repository import Repository
from relquill.sources.workspace import Workspace

REGION = Entity("Region", "regionkey", (Field("regionkey", "int", "r_regionkey"), Field("name", "string", "r_name")), (ToMany("nations", "Nation", "region"),))
NATION = Entity("Nation", "nationkey", (Field("nationkey", "int", "n_nationkey"), Field("name", "string", "n_name")), (ToOne("region", "Region", "n_regionkey"), ToMany("customers", "Customer", "nation")))
CUSTOMER = Entity(
    "Customer", "custkey",
    (Field("custkey", "long", "c_custkey"), Field("name", "string", "c_name", index="PREFIX"), Field("acctbal", "double", "c_acctbal"), Field("mktsegment", "string", "c_mktsegment", index="HASH")),
    (ToOne("nation", "Nation", "c_nationkey"), ToMany("orders", "Order", "customer")),
)
ORDER = Entity(
    "Order", "orderkey",
    (Field("orderkey", "long", "o_orderkey"), Field("status", "string", "o_orderstatus", index="HASH"), Field("total", "double", "o_totalprice", index="BTREE"), Field("orderdate", "datetime", "o_orderdate"), Field("priority", "string", "o_orderpriority")),
    (ToOne("customer", "Customer", "o_custkey"), ToMany("lines", "LineItem", "order"), ManyToMany("parts", "Part", "OrderPart", "l_orderkey", "l_partkey")),
)
LINE = Entity(
    "LineItem", "linenumber",
    (Field("linenumber", "int", "l_linenumber"), Field("quantity", "double", "l_quantity"), Field("returnflag", "string", "l_returnflag"), Field("shipdate", "datetime", "l_shipdate")),
    (ToOne("order", "Order", "l_orderkey"), ToOne("part", "Part", "l_partkey"), ToOne("supplier", "Supplier", "l_suppkey")),
)
PART = Entity("Part", "partkey", (Field("partkey", "long", "p_partkey"), Field("name", "string", "p_name"), Field("brand", "string", "p_brand"), Field("type", "string", "p_type"), Field("size", "int", "p_size"), Field("price", "double", "p_retailprice")))
SUPPLIER = Entity("Supplier", "suppkey", (Field("suppkey", "long", "s_suppkey"), Field("name", "string", "s_name"), Field("acctbal", "double", "s_acctbal")), (ToOne("nation", "Nation", "s_nationkey"),))
EVENT = Entity("Event", "eventid", (Field("eventid", "long", "event_id"), Field("ts", "datetime"), Field("user", "long", "user_id"), Field("kind", "string", "event_type"), Field("value", "double")))
#: Labels with a nullable twin of their id, a boolean, and an embedded struct.
LABEL = Entity(
    "Label", "docid",
    (Field("docid", "long", "doc_id"), Field("maybe", "long"), Field("word", "string"), Field("toxic", "boolean", "is_toxic"), Field("mark.quality", "int"), Field("mark.toxic", "int")),
)
#: Orders whose customer may be missing, and regions that name their nation by a column that is no id.
OPEN_ORDER = Entity("OpenOrder", "orderkey", (Field("orderkey", "long", "o_orderkey"), Field("status", "string", "o_orderstatus")), (ToOne("customer", "RichCustomer", "o_custkey"),))
RICH_CUSTOMER = Entity("RichCustomer", "custkey", (Field("custkey", "long", "c_custkey"), Field("name", "string", "c_name")))
TWIN_NATION = Entity("TwinNation", "nationkey", (Field("nationkey", "int", "n_nationkey"), Field("name", "string", "n_name"), Field("code", "int", "n_regionkey")), (ToMany("spots", "Spot", "nation", as_set=True),))
SPOT = Entity("Spot", "regionkey", (Field("regionkey", "int", "r_regionkey"), Field("name", "string", "r_name")), (ToOne("nation", "TwinNation", "r_regionkey", "code"),))


#: Orders and customers as they are laid out on write, each with the hints of one kind.
LAID_RANGE, LAID_HASH, LAID_COMPOSITE = (
    Entity(name, "orderkey", tuple(dataclasses.replace(f, index=hints.get(f.name, "")) for f in ORDER.fields), composites=composites)
    for name, hints, composites in (("LaidRange", {"total": "BTREE", "priority": "BTREE"}, ()), ("LaidHash", {"status": "HASH", "orderkey": "HASH"}, ()), ("LaidComposite", {}, (("BTREE", ("status", "total")), ("HASH", ("status", "priority")))))
)
LAID_TEXT = Entity("LaidText", "custkey", (Field("custkey", "long", "c_custkey"), Field("name", "string", "c_name", index="SUFFIX"), Field("mktsegment", "string", "c_mktsegment", index="PREFIX")))
#: Regions and the nation that each is ruled from, if there is one: one to one.
REALM = Entity("Realm", "regionkey", (Field("regionkey", "int", "r_regionkey"), Field("name", "string", "r_name")), (InverseOne("capital", "Capital", "realm"),))
CAPITAL = Entity("Capital", "nationkey", (Field("nationkey", "int", "n_nationkey"), Field("name", "string", "n_name")), (ToOne("realm", "Realm", "n_regionkey"),))
#: Orders by a decimal amount, customers by a type of their own.
MONEY = Entity("Money", "orderkey", (Field("orderkey", "long", "o_orderkey"), Field("amount", "decimal")))


def _dollars(value) -> float:
    if isinstance(value, str) and value.startswith("$"):
        return float(value[1:].replace(",", ""))
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    raise TypeError(f"{value!r} is no amount")


register_type(TypeHandler("dollars", T.DoubleType(), _dollars))
ACCOUNT = Entity("Account", "custkey", (Field("custkey", "long", "c_custkey"), Field("balance", "dollars", "c_acctbal")))
NOTE = Entity("Note", "id", (Field("id", "long"), Field("text", "string"), Field("made_by", "string"), Field("changed_by", "string"), Field("made", "datetime"), Field("changed", "datetime")), audit={"created_by": "made_by", "modified_by": "changed_by", "created_date": "made", "modified_date": "changed"})
TAG = Entity("Tag", "id", (Field("id", "string"), Field("label", "string")))


@dataclasses.dataclass
class DeclaredOrder:
    """An entity from its dataclass; also what rows become."""

    orderkey: int = dataclasses.field(metadata={"id": True, "column": "o_orderkey"})
    total: float = dataclasses.field(default=0.0, metadata={"column": "o_totalprice", "index": "BTREE"})
    status: str | None = dataclasses.field(default=None, metadata={"column": "o_orderstatus"})


@dataclasses.dataclass
class Summary:
    """A record of a projection."""

    id: int
    customer: str | None
    total: float


class Kind(enum.Enum):
    CLICK = 1
    PURCHASE = 2
    VIEW = 3


_TABLES = {"region": REGION, "nation": NATION, "customer": CUSTOMER, "orders": ORDER, "lineitem": LINE, "part": PART, "supplier": SUPPLIER, "events": EVENT}
_LABEL_SQL = "(select doc_id, case when quality = 1 then doc_id end as maybe, case when toxic = 0 then 'clean' end as word, toxic = 1 as is_toxic, quality, toxic from labels)"


def open_workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    ws = Workspace(spark)
    for table, entity in _TABLES.items():
        ws.read_parquet(entity, f"{sf_dir}/{table}.parquet")
    ws.add(LABEL, lambda: _labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    ws.add(OPEN_ORDER, lambda: ws.table("Order"))
    ws.add(RICH_CUSTOMER, lambda: ws.table("Customer").filter("c_acctbal > 5000"))
    ws.add(TWIN_NATION, lambda: ws.table("Nation"))
    ws.add(SPOT, lambda: ws.table("Region"))
    ws.add(REALM, lambda: ws.table("Region"))
    ws.add(CAPITAL, lambda: ws.table("Nation").filter("n_regionkey <> 2").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("n_nationkey"), F.min_by("n_name", "n_nationkey").alias("n_name")))
    ws.add(MONEY, lambda: ws.table("Order").select("o_orderkey", F.floor(F.col("o_totalprice") / 50000).cast("decimal(38,10)").alias("amount")))
    ws.add(ACCOUNT, lambda: ws.table("Customer").select("c_custkey", "c_acctbal"))
    ws.add(DeclaredOrder, lambda: ws.table("Order").select("o_orderkey", "o_totalprice", "o_orderstatus"))
    ws.bridge("OrderPart", lambda: ws.table("LineItem").select("l_orderkey", "l_partkey"))
    return ws


def _labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("quality") == 1, F.col("doc_id")).alias("maybe"), F.when(F.col("toxic") == 0, F.lit("clean")).alias("word"), (F.col("toxic") == 1).alias("is_toxic"), F.struct("quality", "toxic").alias("mark"))


Step = tuple[Callable[[Workspace], DataFrame], str | None]


def _ask(entity: str, method: str, *args, keep: str = "", returns: str | None = None, **named) -> Callable[[Workspace], DataFrame]:
    def run(ws: Workspace) -> DataFrame:
        df = Repository(ws, entity).frame(method, *args, returns=returns, **named)
        return df.select(*keep.split()) if keep else df

    return run


def _o(where: str, columns: str = "*") -> str:
    return f"select {columns} from orders where {where}"


def _l(where: str) -> str:
    return f"select doc_id from {_LABEL_SQL} where {where}"


def _on(entity: str, f: Callable[[Repository], DataFrame]) -> Callable[[Workspace], DataFrame]:
    return lambda ws: f(Repository(ws, entity))


_CUT, _LATE = dt.datetime(1998, 9, 2), dt.datetime(1999, 1, 1)
_TS = "timestamp '1998-09-02 00:00:00'"


def _upserts(r: Repository) -> DataFrame:
    batch = r.table.filter("n_nationkey between 1 and 2").withColumn("n_name", F.concat(F.lit("NEW "), "n_name"))
    more = batch.withColumn("n_nationkey", F.col("n_nationkey") + 100)
    return r.save_frame(batch.unionByName(more))


def _assigned(r: Repository) -> DataFrame:
    batch = r.table.filter("r_regionkey < 2").withColumn("r_regionkey", F.lit(None).cast("int"))
    return r.save_frame(batch).groupBy().agg(F.count("*").alias("n"), F.max("r_regionkey").alias("top"), F.countDistinct("r_regionkey").alias("ids"))


def _ids_deleted(r: Repository) -> DataFrame:
    r.deleteAllById([1, 3])
    return r.table


def _linked(r: Repository) -> DataFrame:
    """Every pair that there is, and a new part for every order."""
    bridge = r.ws.table("OrderPart")
    more = bridge.select("l_orderkey", (F.col("l_orderkey") + 1_000_000_000).alias("l_partkey"))
    return r.link("parts", bridge.unionByName(more)).groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("parts"), F.max("l_partkey").alias("top"))


def _kinds(ws: Workspace) -> DataFrame:
    names = enum_names(Kind)
    ws.converters.for_field("Event", "kind", Converter(lambda v: names.store(v).lower(), lambda s: names.load(s.upper())))
    return Repository(ws, "Event").frame("findByKindIn", [Kind.CLICK, Kind.VIEW]).select("event_id", "event_type")


def _saved(r: Repository) -> DataFrame:
    r.saveAll([{"nationkey": 3, "name": "old", "n_regionkey": 0}, {"name": "new", "n_regionkey": 4}, {"nationkey": 3, "name": "last", "n_regionkey": 2}])
    return r.table


def _given_then_assigned(r: Repository) -> DataFrame:
    top = r.save({"name": "first", "n_regionkey": 0})["nationkey"]
    r.save({"nationkey": top + 1, "name": "given", "n_regionkey": 1})
    r.save({"name": "after", "n_regionkey": 2})
    return r.table


def _last_wins(r: Repository) -> DataFrame:
    some = r.table.filter("n_nationkey between 1 and 3")
    early = some.withColumn("n_name", F.lit("early")).withColumn("seq", F.lit(1))
    return r.save_frame(early.unionByName(some.withColumn("n_name", F.concat(F.lit("late "), "n_name")).withColumn("seq", F.lit(2))), order="seq")


def _placed(df: DataFrame) -> DataFrame:
    """With each row's place, so that an order shows; for small results."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


def _carried(entity: str, method: str, text: str, *args, **named) -> Callable[[Workspace], DataFrame]:
    """A query text under a method name, whose TopN is its limit."""
    return lambda ws: type("Carried", (Repository,), {"queries": {method: text}})(ws, entity).frame(method, *args, **named)


def _listed(column: str, key: str) -> Column:
    """A digest of the ids in an array of rows, in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.transform(column, lambda x: x[key])), lambda x: x.cast("string")), ","), 256)


def _is_refused(ask: Callable[[], object]) -> bool:
    try:
        ask()
    except (ValueError, TypeError):
        return True
    return False


def _refusals(entity: str, tries: tuple[str, ...], how: Callable[[Repository, str], object]) -> Callable[[Workspace], DataFrame]:
    def run(ws: Workspace) -> DataFrame:
        r = Repository(ws, entity)
        return ws.spark.createDataFrame([(t, _is_refused(lambda t=t: how(r, t))) for t in tries], "asked string, refused boolean")

    return run


def _expected(tries: tuple[str, ...], accepted: str) -> str:
    quoted = lambda t: t.replace("'", "''")
    rows = ", ".join(f"('{quoted(t)}', {'false' if t == accepted else 'true'})" for t in tries)
    return f"select * from (values {rows}) t(asked, refused)"


_BAD_NAMES = (
    "findByStatus", "findBy", "findByAnd", "findByStatusAnd", "findByStatusOr", "findByStatusAndAndTotal", "findByStatusOrderBy", "fetchByStatus", "findByNope",
    "findTop0ByStatus", "findByStatusGreaterThanLessThan", "findAllGroupingByStatusOrderByTotal", "findAllGroupingBy", "findByStatusOrderByNope",
)
_BAD_TEXTS = (
    "select o from Order o where o.status = 'F'", "select o from Order o right join o.customer c", "select o from Order o full join o.customer c", "select count(*) from Order o",
    "select count(o.total) from Order o", "select count(o) from Order o having count(o) > 1", "select count(o) from Order o group by o.status having not count(o) > 1",
    "select o from Order o group by o.status having count(o) > 1", "select o.total from Order o group by o.status", "select o from Order o group by o.status order by o.status",
    "select o.customer as c from Order o", "select o.lines.quantity as q from Order o", "select o, o.total as total from Order o", "select o.total as x, o.status as x from Order o",
    "update Order o set o.orderkey = 1", "update Order o set o.customer.name = 'x'", "select o from Order o where", "select o from Order o where o.nope = 1", "select o from Nope o",
    "select o from Order o where not o.total between 1 and 2",
)


def _result_kinds(ws: Workspace) -> DataFrame:
    class Nations(Repository):
        entity = "Nation"
        queries = {
            "named": "select n.name as name from Nation n where n.nationkey = :k", "below": "select n.name as name from Nation n where n.nationkey < :k", "regions": "select n.region.name as name from Nation n",
            "renamed": "update Nation n set n.name = 'x' where n.nationkey < :k", "again": "update Nation n set n.name = 'y' where n.nationkey < :k", "gone": "delete from Nation n where n.nationkey < :k",
        }
        returns = {"named": "one", "below": "one", "findByName": "optional", "regions": "set", "renamed": "int", "again": "long", "gone": "void", "countByRegionName": "map"}

    r = Nations(ws)
    try:
        several = str(r.below(k=9))
    except LookupError:
        several = "refused"
    rows = [("one", r.named(k=3)["name"]), ("none", str(r.named(k=-3))), ("several", several), ("optional", str(r.findByName("nobody"))), ("set", str(len(r.regions()))), ("map", str(sum(r.countByRegionName().values())))]
    rows += [("int", str(r.renamed(k=2))), ("long", str(r.again(k=3))), ("void", str(r.gone(k=4))), ("left", str(r.count())), ("list", str(len(r.findByNameNot("y"))))]
    return ws.spark.createDataFrame(rows, "kind string, value string")


def _records(ws: Workspace) -> DataFrame:
    class Orders(Repository):
        entity = "Order"
        queries = {"summaries": "select o.customer.name as customer, o.total as total, o.orderkey as id from Order o where o.total >= :min"}
        records = {"summaries": Summary}

    return ws.spark.createDataFrame([dataclasses.astuple(x) for x in Orders(ws).summaries(min=400000)], "id long, customer string, total double")


def _objects(ws: Workspace) -> DataFrame:
    class Orders(Repository):
        entity, made_as = "DeclaredOrder", DeclaredOrder

    return Orders(ws).each("findByStatusAndTotalGreaterThan", lambda x: (x.orderkey, x.status, x.total), "orderkey long, status string, total double", "P", 300000)


def _noted(ws: Workspace) -> DataFrame:
    """Hooks and audit fields: two new rows, one of them saved again by someone else, and loaded."""

    class Notes(Repository):
        entity = "Note"

        def pre_persist(self, row):
            return {"text": f"new {row['text']}"}

        def pre_update(self, row):
            return {"text": f"old {row['text']}"}

        def post_load(self, row):
            return row | {"text": row["text"].upper()}

    ws.add(NOTE)
    people = iter(["ann", "ann", "ann", "ann", "bob", "bob"])
    notes = Notes(ws, user=lambda: next(people))
    notes.saveAll([{"text": "a"}, {"text": "b"}])
    notes.save({**Repository(ws, "Note").findById(2).asDict(), "text": "c"})
    loaded = [(x["id"], x["text"], x["made_by"], x["changed_by"], x["made"] is not None and x["made"] <= x["changed"]) for x in notes.findAll()]
    return ws.spark.createDataFrame(loaded, "id long, text string, made_by string, changed_by string, dated boolean")


def _tagged(ws: Workspace) -> DataFrame:
    """Text ids that are made up for rows and for a DataFrame."""
    ws.add(TAG)
    tags = Repository(ws, "Tag")
    tags.saveAll([{"label": "a"}, {"label": "b"}, {"id": "own", "label": "c"}])
    tags.save_frame(ws.table("Customer").select(F.lit(None).cast("string").alias("id"), F.col("c_name").alias("label")))
    shape = F.col("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return tags.table.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(shape).alias("made"))


def _generated(ws: Workspace) -> DataFrame:
    numbers = itertools.count(7)
    ws.add(dataclasses.replace(TAG, generation="custom", generator=lambda: f"T-{next(numbers)}"))
    Repository(ws, "Tag").saveAll([{"label": "a"}, {"id": "own", "label": "b"}, {"label": "c"}])
    return ws.table("Tag")


def _by_class(ws: Workspace) -> DataFrame:
    ws.converters.for_class(Kind, Converter(lambda v: v.name.lower(), lambda s: Kind[s.upper()]))
    return Repository(ws, "Event").frame("findByKind", Kind.PURCHASE).select("event_id", "event_type")


def _two_workspaces(ws: Workspace) -> DataFrame:
    engine, nations = Engine(ws.spark), ws.table("Nation")
    for name in ("one", "two"):
        engine.workspace(name).add(NATION, nations)
    Repository(engine.workspace("one"), "Nation").save({"name": "more", "n_regionkey": 1})
    return ws.spark.createDataFrame([(name, Repository(engine.workspace(name), "Nation").count()) for name in ("one", "two")], "name string, n long")


def _laid_out(entity: Entity, table: str, method: str, *args) -> Callable[[Workspace], DataFrame]:
    """A question to a table that was written in its entity's layout and read again."""

    def run(ws: Workspace) -> DataFrame:
        path, out, back = posixpath.join(ws.storage, f"layout-{uuid.uuid4().hex}"), Workspace(ws.spark), Workspace(ws.spark)
        out.add(entity, ws.table(table))
        out.write_parquet(entity.name, path, files=4)
        back.read_parquet(entity, path)
        return Repository(back, entity.name).frame(method, *args)

    return run


CATALOGUE: dict[str, Step] = {
    # scans, ids, counts
    "find_all": (_ask("Nation", "findAll"), "select * from nation"),
    "find_all_orders": (_ask("Order", "findAll"), "select * from orders"),
    "find_by_id": (_on("Order", lambda r: r.by_id(7)), _o("o_orderkey = 7")),
    "find_all_by_id": (_on("Order", lambda r: r.by_ids([1, 2, 3, 7, 999999999])), _o("o_orderkey in (1, 2, 3, 7, 999999999)")),
    "exists_by_id": (_ask("Order", "existsByOrderkey", 7), "select count(*) > 0 as found from orders where o_orderkey = 7"),
    "count_all": (_ask("Order", "count"), "select count(*) as cnt from orders"),
    "count_by_status": (_ask("Order", "countByStatus", "F"), "select count(*) as cnt from orders where o_orderstatus = 'F'"),
    "count_distinct_rows": (_ask("Order", "countDistinctByStatus", "O"), "select count(*) as cnt from orders where o_orderstatus = 'O'"),
    "count_text": (_ask("Order", "select count(o) from Order o where o.total > :min", min=200000), "select count(*) as cnt from orders where o_totalprice > 200000"),
    "exists_by_status": (_ask("Order", "existsByStatus", "P"), "select count(*) > 0 as found from orders where o_orderstatus = 'P'"),
    "exists_none": (_ask("Order", "existsByStatus", "Z"), "select count(*) > 0 as found from orders where o_orderstatus = 'Z'"),
    # comparisons
    "eq": (_ask("Order", "findByStatus", "F"), _o("o_orderstatus = 'F'")),
    "ne": (_ask("Order", "findByStatusNot", "F"), _o("o_orderstatus is distinct from 'F'")),
    "gt": (_ask("Order", "findByTotalGreaterThan", 300000), _o("o_totalprice > 300000")),
    "gte": (_ask("Order", "findByTotalGreaterThanEqual", 300000), _o("o_totalprice >= 300000")),
    "lt": (_ask("Order", "findByTotalLessThan", 5000), _o("o_totalprice < 5000")),
    "lte": (_ask("Order", "findByTotalLessThanEqual", 5000), _o("o_totalprice <= 5000")),
    "between": (_ask("Order", "findByTotalBetween", 10000, 20000), _o("o_totalprice between 10000 and 20000")),
    "after": (_ask("Order", "findByOrderdateAfter", _CUT), _o(f"o_orderdate > {_TS}")),
    "before": (_ask("Order", "findByOrderdateBefore", _CUT), _o(f"o_orderdate < {_TS}")),
    "between_ts": (_ask("Order", "findByOrderdateBetween", _CUT, _LATE), _o(f"o_orderdate between {_TS} and timestamp '1999-01-01 00:00:00'")),
    "in_list": (_ask("Order", "findByPriorityIn", ["1-URGENT", "2-HIGH"]), _o("o_orderpriority in ('1-URGENT', '2-HIGH')")),
    "not_in_list": (_ask("Order", "findByPriorityNotIn", ["1-URGENT", "2-HIGH"]), _o("o_orderpriority not in ('1-URGENT', '2-HIGH')")),
    "in_empty": (_ask("Order", "findByPriorityIn", []), _o("false")),
    "in_text": (_ask("Part", "select p from Part p where p.size in (1, 2, 3)"), "select * from part where p_size in (1, 2, 3)"),
    "composite_eq": (_ask("Order", "getByStatusAndPriority", "F", "1-URGENT"), _o("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")),
    "composite_range": (_ask("Order", "readByStatusAndTotalBetween", "F", 1000, 50000), _o("o_orderstatus = 'F' and o_totalprice between 1000 and 50000")),
    "string_range": (_ask("Customer", "queryByNameBetween", "Customer#000000010", "Customer#000000020"), "select * from customer where c_name between 'Customer#000000010' and 'Customer#000000020'"),
    "event_range": (_ask("Event", "streamByTsBetweenAndKind", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 4), "click", keep="event_id user_id"), "select event_id, user_id from events where ts between timestamp '2024-01-02 00:00:00' and timestamp '2024-01-04 00:00:00' and event_type = 'click'"),
    "not_in_empty": (_ask("Nation", "findByNameNotIn", []), "select * from nation"),
    "in_many_ids": (_on("Order", lambda r: r.by_ids(range(1, 6000, 2))), _o("o_orderkey between 1 and 5999 and o_orderkey % 2 = 1")),
    "converted_argument": (_kinds, "select event_id, event_type from events where event_type in ('click', 'view')"),
    "gt_largest": (_ask("Part", "findBySizeGreaterThan", 2147483647), "select * from part where p_size > 2147483647"),
    # nulls
    "eq_null_arg": (_ask("Label", "findByMaybe", None, keep="doc_id"), _l("maybe is null")),
    "eq_null_text": (_ask("Label", "findByWord", None, keep="doc_id"), _l("word is null")),
    "ne_with_nulls": (_ask("Label", "findByMaybeNot", 0, keep="doc_id"), _l("maybe is distinct from 0")),
    "not_in_with_nulls": (_ask("Label", "findByMaybeNotIn", [0, 1], keep="doc_id"), _l("not coalesce(maybe in (0, 1), false)")),
    "not_like_with_nulls": (_ask("Label", "findByWordNotLike", "c%", keep="doc_id"), _l("not coalesce(word like 'c%', false)")),
    "not_containing_with_nulls": (_ask("Label", "findByWordNotContaining", "x", keep="doc_id"), _l("not coalesce(contains(word, 'x'), false)")),
    "is_null": (_ask("Label", "findByMaybeIsNull", keep="doc_id"), _l("maybe is null")),
    "not_null": (_ask("Label", "findByMaybeNotNull", keep="doc_id"), _l("maybe is not null")),
    "is_true": (_ask("Label", "findByToxicTrue", keep="doc_id"), _l("is_toxic")),
    "is_false": (_ask("Label", "findByToxicIsFalse", keep="doc_id"), _l("not is_toxic")),
    "embedded_path": (_ask("Label", "findByMarkQuality", 0, keep="doc_id"), _l("quality = 0")),
    "embedded_text": (_ask("Label", "select l from Label l where l.mark.quality = 1 and l.mark.toxic = 1", keep="doc_id"), _l("quality = 1 and toxic = 1")),
    # patterns
    "like": (_ask("Part", "select p from Part p where p.name like '%a%e%'"), "select * from part where p_name like '%a%e%'"),
    "not_like": (_ask("Part", "select p from Part p where p.name not like '%a%'"), "select * from part where p_name not like '%a%'"),
    "ilike": (_ask("Part", "select p from Part p where p.name ilike '%A%'"), "select * from part where p_name ilike '%A%'"),
    "not_ilike": (_ask("Part", "select p from Part p where p.name not ilike '%A%'"), "select * from part where p_name not ilike '%A%'"),
    "like_backslash": (_ask("Part", "findByNameLike", "a\\b%"), "select * from part where p_name like 'a\\b%'"),
    "starting_with": (_ask("Customer", "findByNameStartingWith", "Customer#00000001"), "select * from customer where starts_with(c_name, 'Customer#00000001')"),
    "not_starting_with": (_ask("Customer", "findByNameNotStartingWith", "Customer#0000000"), "select * from customer where not starts_with(c_name, 'Customer#0000000')"),
    "ending_with": (_ask("Customer", "findByNameEndingWith", "7"), "select * from customer where ends_with(c_name, '7')"),
    "not_ending_with": (_ask("Customer", "findByNameNotEndingWith", "7"), "select * from customer where not ends_with(c_name, '7')"),
    "containing": (_ask("Part", "findByTypeContaining", "S"), "select * from part where contains(p_type, 'S')"),
    "not_containing": (_ask("Part", "findByTypeNotContaining", "S"), "select * from part where not contains(p_type, 'S')"),
    "containing_empty": (_ask("Part", "findByTypeContaining", ""), "select * from part where p_type is not null"),
    "ignore_case_eq": (_ask("Customer", "findByMktsegmentEqualsIgnoreCase", "building"), "select * from customer where lower(c_mktsegment) = 'building'"),
    "containing_ignore_case": (_ask("Part", "findByTypeContainingIgnoreCase", "s"), "select * from part where contains(lower(p_type), 's')"),
    "like_ignore_case": (_ask("Part", "findByTypeLikeIgnoreCase", "S%"), "select * from part where lower(p_type) like 's%'"),
    "all_ignore_case": (_ask("Customer", "findByMktsegmentAndNameContainingAllIgnoreCase", "Building", "CUSTOMER"), "select * from customer where lower(c_mktsegment) = 'building' and contains(lower(c_name), 'customer')"),
    # trees
    "and_or_precedence": (_ask("Order", "findByStatusOrPriorityAndTotalGreaterThan", "P", "1-URGENT", 400000), _o("o_orderstatus = 'P' or o_orderpriority = '1-URGENT' and o_totalprice > 400000")),
    "text_parens": (_ask("Order", "select o from Order o where (o.status = 'P' or o.priority = ?1) and o.total > ?2", "1-URGENT", 400000), _o("(o_orderstatus = 'P' or o_orderpriority = '1-URGENT') and o_totalprice > 400000")),
    "text_not": (_ask("Order", "select o from Order o where not (o.status = 'F' or o.total > 100000)"), _o("o_orderstatus <> 'F' and o_totalprice <= 100000")),
    "text_not_nulls": (_ask("Label", "select l from Label l where not (l.maybe = 0)", keep="doc_id"), _l("maybe is distinct from 0")),
    # order, limit, distinct
    "order_asc": (_ask("Nation", "findAllByOrderByNameAsc"), "select * from nation order by n_name"),
    "order_desc": (_ask("Order", "findTop20ByOrderByTotalDesc"), "select * from orders order by o_totalprice desc, o_orderkey desc limit 20"),
    "order_multi": (_ask("Order", "findTop50ByOrderByPriorityAscAndTotalDesc"), "select * from orders order by o_orderpriority, o_totalprice desc, o_orderkey limit 50"),
    "order_text": (_ask("Nation", "select n from Nation n order by n.name desc"), "select * from nation order by n_name desc"),
    "order_by_relation": (_ask("Nation", "findTop7ByOrderByRegionNameDesc"), "select n.* from nation n left join region r on n_regionkey = r_regionkey order by r_name desc, n_nationkey desc limit 7"),
    "top_n": (_ask("Order", "findTop3ByStatusOrderByTotalDesc", "F"), "select * from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey desc limit 3"),
    "first": (_ask("Order", "findFirstByStatusOrderByOrderdateAsc", "F"), "select * from orders where o_orderstatus = 'F' order by o_orderdate, o_orderkey limit 1"),
    "top_n_nulls_last": (_ask("Label", "findTop10ByOrderByMaybeDesc", keep="doc_id"), f"select doc_id from {_LABEL_SQL} order by maybe desc nulls first, doc_id desc limit 10"),
    "top_n_nulls_first": (_ask("Label", "findTop10ByOrderByMaybeAsc", keep="doc_id"), f"select doc_id from {_LABEL_SQL} order by maybe nulls last, doc_id limit 10"),
    "limit_unordered": (_ask("Order", "findTop5ByStatus", "O"), "select * from orders where o_orderstatus = 'O' order by o_orderkey limit 5"),
    "distinct_projection": (_ask("Order", "select distinct o.status as status, o.priority as priority from Order o"), "select distinct o_orderstatus as status, o_orderpriority as priority from orders"),
    "distinct_ordered": (lambda ws: _placed(_ask("Order", "select distinct o.priority as priority, o.status as status from Order o order by o.total desc")(ws)), "select o_orderpriority as priority, o_orderstatus as status, cast(row_number() over (order by max(o_totalprice) desc) as int) as place from orders group by o_orderpriority, o_orderstatus"),
    "distinct_ordered_by_projected": (lambda ws: _placed(_ask("Customer", "select distinct c.nation.name as nation from Customer c order by c.nation.name desc")(ws)), "select n_name as nation, cast(row_number() over (order by n_name desc) as int) as place from (select distinct n_name from customer join nation on c_nationkey = n_nationkey)"),
    "distinct_ordered_top": (lambda ws: _placed(_carried("Order", "findTop9Kinds", "select distinct o.status as status, o.priority as priority from Order o order by o.total desc")(ws)), "select o_orderstatus as status, o_orderpriority as priority, cast(row_number() over (order by max(o_totalprice) desc) as int) as place from (select * from orders order by o_totalprice desc, o_orderkey desc limit 9) group by o_orderstatus, o_orderpriority"),
    "order_is_kept": (lambda ws: _placed(_ask("Nation", "findAllByOrderByNameDesc")(ws)), "select *, cast(row_number() over (order by n_name desc) as int) as place from nation"),
    "limit_by_method_name": (_carried("Order", "findTop4ByWorth", "select o from Order o where o.status = :s order by o.total desc", s="O"), "select * from orders where o_orderstatus = 'O' order by o_totalprice desc, o_orderkey desc limit 4"),
    "distinct_entities": (_ask("Nation", "findDistinctByNameNot", "x"), "select * from nation"),
    # relations
    "join_to_one": (_ask("Order", "findByCustomerMktsegment", "BUILDING"), _o("o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")),
    "join_to_one_two_conditions": (_ask("Order", "findByCustomerMktsegmentAndCustomerAcctbalGreaterThan", "BUILDING", 5000), _o("o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING' and c_acctbal > 5000)")),
    "join_one_to_many": (_ask("Customer", "findByOrdersStatus", "P"), "select * from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')"),
    "join_many_to_many": (_ask("Order", "findByPartsSize", 1), _o("o_orderkey in (select l_orderkey from lineitem where l_partkey in (select p_partkey from part where p_size = 1))")),
    "join_multi_hop": (_ask("Order", "findByCustomerNationRegionName", "ASIA"), _o("o_custkey in (select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey in (select r_regionkey from region where r_name = 'ASIA')))")),
    "join_or_base": (_ask("Order", "findByCustomerMktsegmentOrTotalGreaterThan", "BUILDING", 400000), _o("o_totalprice > 400000 or exists (select 1 from customer where c_custkey = o_custkey and c_mktsegment = 'BUILDING')")),
    "join_not_equal": (_ask("Order", "findByCustomerMktsegmentNot", "BUILDING"), _o("o_custkey in (select c_custkey from customer where c_mktsegment <> 'BUILDING')")),
    "join_text": (_ask("Order", "select o from Order o join o.customer c where c.mktsegment = :s and o.status = 'F'", s="MACHINERY"), _o("o_orderstatus = 'F' and o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY')")),
    "join_fetch": (_ask("Order", "select o from Order o join fetch o.customer c where c.acctbal < 0"), _o("o_custkey in (select c_custkey from customer where c_acctbal < 0)")),
    "join_path_separator": (_ask("Order", "findByCustomer_Nation_Name", "NATION_3"), _o("o_custkey in (select c_custkey from customer where c_nationkey = (select n_nationkey from nation where n_name = 'NATION_3'))")),
    "join_non_id": (_ask("Spot", "findByNationNameIn", ["NATION_1", "NATION_6", "NATION_8"]), "select * from region where r_regionkey in (select n_regionkey from nation where n_name in ('NATION_1', 'NATION_6', 'NATION_8'))"),
    "join_missing_target": (_ask("OpenOrder", "findByCustomerNameNot", "x", keep="o_orderkey"), "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)"),
    "join_or_one_to_many": (_ask("Customer", "findByOrdersStatusOrAcctbalLessThan", "P", 0), "select * from customer where c_acctbal < 0 or c_custkey in (select o_custkey from orders where o_orderstatus = 'P')"),
    "join_or_many_to_many": (_ask("Order", "findByPartsSizeOrTotalLessThan", 1, 2000), _o("o_totalprice < 2000 or o_orderkey in (select l_orderkey from lineitem where l_partkey in (select p_partkey from part where p_size = 1))")),
    "join_or_count": (_ask("Order", "countByCustomerMktsegmentOrTotalGreaterThan", "BUILDING", 400000), "select count(*) as cnt from orders where o_totalprice > 400000 or o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')"),
    "join_exists": (_ask("Order", "existsByCustomerNationName", "NATION_24"), "select count(*) > 0 as found from orders where o_custkey in (select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_name = 'NATION_24'))"),
    "join_bare": (_ask("Order", "select o from Order o join o.customer c where o.status = 'P'"), _o("o_orderstatus = 'P'")),
    "join_left_noop": (_ask("Order", "select o from Order o left join o.customer c where c.mktsegment = 'BUILDING' and o.status = 'P'"), _o("o_orderstatus = 'P'")),
    "join_count": (_ask("Order", "countByCustomerMktsegment", "BUILDING"), "select count(*) as cnt from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')"),
    "join_inverse_one": (_ask("Realm", "findByCapitalNationkeyLessThan", 3), "select * from region where r_regionkey in (select n_regionkey from nation where n_regionkey <> 2 group by n_regionkey having min(n_nationkey) < 3)"),
    "join_inverse_one_or": (_ask("Realm", "findByCapitalNationkeyLessThanOrName", 1, "ASIA"), "select * from region where r_name = 'ASIA' or r_regionkey in (select n_regionkey from nation where n_regionkey <> 2 group by n_regionkey having min(n_nationkey) < 1)"),
    # projections
    "project_flat": (_ask("Order", "select o.orderkey as id, o.total as total from Order o where o.total >= :min", min=300000), _o("o_totalprice >= 300000", "o_orderkey as id, o_totalprice as total")),
    "project_to_one": (_ask("Order", "select o.orderkey as id, o.customer.name as customer from Order o where o.status = 'P'"), "select o_orderkey as id, c_name as customer from orders left join customer on o_custkey = c_custkey where o_orderstatus = 'P'"),
    "project_two_hops": (_ask("Order", "select o.orderkey as id, o.customer.nation.name as nation, o.customer.name as customer from Order o where o.status = 'P' order by o.total desc"), "select o_orderkey as id, n_name as nation, c_name as customer from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey where o_orderstatus = 'P'"),
    "project_left_null": (_ask("OpenOrder", "select o.orderkey as id, o.customer.name as customer from OpenOrder o"), "select o_orderkey as id, c_name as customer from orders left join customer on o_custkey = c_custkey and c_acctbal > 5000"),
    "project_non_id": (_ask("Spot", "select s.name as region, s.nation.name as nation from Spot s"), "select r_name as region, (select arg_min(n_name, n_nationkey) from nation where n_regionkey = r_regionkey) as nation from region"),
    "project_inverse_one": (_ask("Realm", "select r.name as region, r.capital.name as capital from Realm r"), "select r_name as region, (select arg_min(n_name, n_nationkey) from nation where n_regionkey = r_regionkey and n_regionkey <> 2) as capital from region"),
    "project_embedded": (_ask("Label", "select l.docid as id, l.mark.quality as quality from Label l where l.mark.toxic = 1"), "select doc_id as id, quality from labels where toxic = 1"),
    # groups
    "group_count": (_ask("Order", "countByStatus", returns="map"), "select o_orderstatus as status, count(*) as cnt from orders group by all"),
    "group_count_two_keys": (_ask("Order", "countByTotalGroupingByStatusAndPriority"), "select o_orderstatus as status, o_orderpriority as priority, count(*) as cnt from orders group by all"),
    "group_count_filtered": (_ask("Order", "select count(o) from Order o where o.total > 100000 group by o.priority"), "select o_orderpriority as priority, count(*) as cnt from orders where o_totalprice > 100000 group by all"),
    "group_by_relation": (_ask("Order", "select count(o) from Order o group by o.customer.mktsegment"), "select c_mktsegment as customer_mktsegment, count(*) as cnt from orders left join customer on o_custkey = c_custkey group by all"),
    "group_having": (_ask("Order", "select count(o) from Order o where o.customer.mktsegment = 'BUILDING' group by o.priority, o.status having count(o) > :min", min=10), "select o_orderpriority as priority, o_orderstatus as status, count(*) as cnt from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') group by all having count(*) > 10"),
    "group_having_or": (_ask("Order", "select count(o) from Order o group by o.priority, o.status having count(o) > :a or count(o) < :b and count(o) <> 0", a=1000, b=500), "select o_orderpriority as priority, o_orderstatus as status, count(*) as cnt from orders group by all having (count(*) > 1000 or count(*) < 500) and count(*) <> 0"),
    "group_null_key": (_ask("Label", "countByWord", returns="map"), f"select word, count(*) as cnt from {_LABEL_SQL} group by all"),
    "group_by_time": (_ask("Order", "countByOrderdate", returns="map"), "select o_orderdate as orderdate, count(*) as cnt from orders group by all"),
    "group_by_decimal": (lambda ws: _ask("Money", "countByAmount", returns="map")(ws).select(F.col("amount").cast("long").alias("amount"), "cnt"), "select cast(floor(o_totalprice / 50000) as bigint) as amount, count(*) as cnt from orders group by all"),
    "group_list": (lambda ws: _ask("Order", "findAllGroupingByStatus")(ws).select("status", F.size("items").alias("n"), _listed("items", "o_orderkey").alias("ids")), "select o_orderstatus as status, cast(count(*) as int) as n, sha256(string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey)) as ids from orders group by all"),
    "group_set": (lambda ws: _ask("Order", "findAllGroupingByStatusAndPriorityAsSet")(ws).select("status", "priority", F.size("items").alias("n"), _listed("items", "o_orderkey").alias("ids")), "select o_orderstatus as status, o_orderpriority as priority, cast(count(*) as int) as n, sha256(string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey)) as ids from orders group by all"),
    "group_rows": (_on("Order", lambda r: r.grouped_rows("findAllGroupingByPriority").select("priority", "item.o_orderkey", "item.o_totalprice")), "select o_orderpriority as priority, o_orderkey, o_totalprice from orders"),
    # hydration
    "hydrate_one_to_many": (lambda ws: Repository(ws, "Customer").hydrated("orders").select("c_custkey", F.size("orders").alias("n"), _listed("orders", "o_orderkey").alias("ids"), F.get("orders", F.lit(0))["o_totalprice"].alias("total")), "select c_custkey, cast(count(o_orderkey) as int) as n, sha256(coalesce(string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey), '')) as ids, arg_min(o_totalprice, o_orderkey) as total from customer left join orders on o_custkey = c_custkey group by all"),
    "hydrate_to_one": (lambda ws: Repository(ws, "Nation").hydrated("region").select("n_nationkey", F.col("region.r_name").alias("region")), "select n_nationkey, r_name as region from nation left join region on n_regionkey = r_regionkey"),
    "hydrate_inverse_one": (lambda ws: Repository(ws, "Realm").hydrated("capital").select("r_name", F.col("capital.n_name").alias("capital")), "select r_name, (select arg_min(n_name, n_nationkey) from nation where n_regionkey = r_regionkey and n_regionkey <> 2) as capital from region"),
    "hydrate_many_to_many": (lambda ws: Repository(ws, "Order").hydrated("parts", only={"parts": ["p_partkey", "p_size"]}).select("o_orderkey", F.size("parts").alias("n"), _listed("parts", "p_partkey").alias("ids"), F.aggregate(F.transform("parts", lambda x: x["p_size"].cast("long")), F.lit(0).cast("long"), lambda s, x: s + x).alias("sizes")), "select o_orderkey, cast(count(p_partkey) as int) as n, sha256(coalesce(string_agg(cast(p_partkey as varchar), ',' order by p_partkey), '')) as ids, cast(coalesce(sum(p_size), 0) as bigint) as sizes from orders left join (select distinct l_orderkey, l_partkey from lineitem) on l_orderkey = o_orderkey left join part on p_partkey = l_partkey group by all"),
    "hydrate_set": (lambda ws: Repository(ws, "TwinNation").hydrated("spots").select("n_nationkey", F.size("spots").alias("n")), "select n_nationkey, cast(count(r_regionkey) as int) as n from nation left join region on r_regionkey = n_regionkey group by all"),
    # results, records, objects
    "return_kinds": (_result_kinds, "select 'one' as kind, n_name as value from nation where n_nationkey = 3 union all values ('none', 'None'), ('several', 'refused'), ('optional', 'None') union all select 'set', cast(count(distinct n_regionkey) as varchar) from nation union all select 'map', cast(count(*) as varchar) from nation union all select 'int', cast(count(*) as varchar) from nation where n_nationkey < 2 union all select 'long', cast(count(*) as varchar) from nation where n_nationkey < 3 union all values ('void', 'None') union all select 'left', cast(count(*) as varchar) from nation where n_nationkey >= 4 union all select 'list', cast(count(*) as varchar) from nation where n_nationkey >= 4"),
    "record_projection": (_records, "select o_orderkey as id, c_name as customer, o_totalprice as total from orders left join customer on o_custkey = c_custkey where o_totalprice >= 400000"),
    "materialised_objects": (_objects, "select o_orderkey as orderkey, o_orderstatus as status, o_totalprice as total from orders where o_orderstatus = 'P' and o_totalprice > 300000"),
    "declared_entity": (_ask("DeclaredOrder", "findTop5ByStatusOrderByTotalDesc", "F"), "select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey desc limit 5"),
    "refused_names": (_refusals("Order", _BAD_NAMES, lambda r, t: r.compile(t)), _expected(_BAD_NAMES, "findByStatus")),
    "refused_texts": (_refusals("Order", _BAD_TEXTS, lambda r, t: r.frame(t)), _expected(_BAD_TEXTS, "select o from Order o where o.status = 'F'")),
    "hooks_and_audit": (_noted, "select * from (values (cast(1 as bigint), 'NEW A', 'ann', 'ann', true), (2, 'OLD C', 'ann', 'bob', true)) t(id, text, made_by, changed_by, dated)"),
    "converter_by_class": (_by_class, "select event_id, event_type from events where event_type = 'purchase'"),
    "custom_type": (_ask("Account", "findByBalanceBetween", "$1,000.50", 5000), "select c_custkey, c_acctbal from customer where c_acctbal between 1000.5 and 5000"),
    "named_workspaces": (_two_workspaces, "select 'one' as name, count(*) + 1 as n from nation union all select 'two', count(*) from nation"),
    # layouts on write
    "layout_range": (_laid_out(LAID_RANGE, "Order", "findByTotalBetween", 10000, 20000), _o("o_totalprice between 10000 and 20000")),
    "layout_hash": (_laid_out(LAID_HASH, "Order", "findByOrderkeyIn", [7, 77, 777]), _o("o_orderkey in (7, 77, 777)")),
    "layout_composite_range": (_laid_out(LAID_COMPOSITE, "Order", "findByStatusAndTotalGreaterThan", "P", 200000), _o("o_orderstatus = 'P' and o_totalprice > 200000")),
    "layout_composite_hash": (_laid_out(LAID_COMPOSITE, "Order", "findByStatusAndPriority", "F", "1-URGENT"), _o("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")),
    "layout_prefix": (_laid_out(LAID_TEXT, "Customer", "findByMktsegmentStartingWith", "B"), "select * from customer where starts_with(c_mktsegment, 'B')"),
    "layout_suffix": (_laid_out(LAID_TEXT, "Customer", "findByNameEndingWith", "77"), "select * from customer where ends_with(c_name, '77')"),
    "layout_not_suffix": (_laid_out(LAID_TEXT, "Customer", "findByNameNotEndingWith", "7"), "select * from customer where not ends_with(c_name, '7')"),
    # changes: the table each leaves
    "save_given_then_assigned": (_on("Nation", _given_then_assigned), "select * from nation union all select cast(max(n_nationkey) + 1 as int), 'first', 0 from nation union all select cast(max(n_nationkey) + 2 as int), 'given', 1 from nation union all select cast(max(n_nationkey) + 3 as int), 'after', 2 from nation"),
    "save_frame_last_wins": (_on("Nation", _last_wins), "select * replace (case when n_nationkey between 1 and 3 then 'late ' || n_name else n_name end as n_name) from nation"),
    "id_uuid": (_tagged, "select count(*) + 3 as n, count(*) + 3 as ids, count(*) + 2 as made from customer"),
    "id_custom": (_generated, "select * from (values ('T-7', 'a'), ('own', 'b'), ('T-8', 'c')) t(id, label)"),
    "update_query": (_ask("Order", "update Order o set o.status = 'X', o.priority = :p where o.total > 300000", p="none"), "select * replace (case when o_totalprice > 300000 then 'X' else o_orderstatus end as o_orderstatus, case when o_totalprice > 300000 then 'none' else o_orderpriority end as o_orderpriority) from orders"),
    "update_by_relation": (_ask("Order", "update Order o set o.status = 'X' where o.customer.mktsegment = 'BUILDING'"), "select * replace (case when o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') then 'X' else o_orderstatus end as o_orderstatus) from orders"),
    "delete_by": (_ask("Order", "deleteByStatus", "F"), _o("not coalesce(o_orderstatus = 'F', false)")),
    "delete_text": (_ask("Label", "delete from Label l where l.maybe <> 0", keep="doc_id"), _l("maybe is not distinct from 0")),
    "update_to_null": (_ask("Label", "update Label l set l.word = :w where l.mark.quality = 0", w=None, keep="doc_id word"), f"select doc_id, case when quality <> 0 then word end as word from {_LABEL_SQL}"),
    "remove_by_relation": (_ask("Order", "removeByCustomerMktsegment", "BUILDING"), _o("o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")),
    "save_all": (_on("Nation", _saved), "select * from nation where n_nationkey <> 3 union all select 3, 'last', 2 union all select cast(max(n_nationkey) + 1 as int), 'new', 4 from nation"),
    "delete_by_id": (_on("Nation", lambda r: (r.deleteById(7), r.table)[1]), "select * from nation where n_nationkey <> 7"),
    "delete_all_by_id": (_on("Region", _ids_deleted), "select * from region where r_regionkey not in (1, 3)"),
    "delete_all": (_on("Region", lambda r: (r.deleteAll(), r.table)[1]), "select * from region where false"),
    "upsert": (_on("Nation", _upserts), "select * replace (case when n_nationkey between 1 and 2 then 'NEW ' || n_name else n_name end as n_name) from nation union all select n_nationkey + 100, 'NEW ' || n_name, n_regionkey from nation where n_nationkey between 1 and 2"),
    "id_assignment": (_on("Region", _assigned), "select count(*) + 2 as n, cast(max(r_regionkey) + 2 as int) as top, count(*) + 2 as ids from region"),
    "many_to_many_link": (_on("Order", _linked), "select l_orderkey, count(distinct l_partkey) + 1 as parts, l_orderkey + 1000000000 as top from lineitem group by l_orderkey"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(step: Callable[[Workspace], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: step(open_workspace(spark, sf_dir))

    return {name: bound(step) for name, (step, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one market segment counted by priority and status, large groups only."""
    return queries()["group_having"](spark, sf_dir)
