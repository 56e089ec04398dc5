"""Operators on small tables with nulls, changes, and plans."""

import datetime as dt
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import relquill
from relquill import Engine, Entity, Field, Repository, ToMany, ToOne, catalog
from relquill.functions.values import enum_names
from relquill.operators.lower import null_if_empty

SF = "/root/testdata/sf0.001"
ITEM = Entity("Item", "id", (Field("id", "long"), Field("name", "string"), Field("n", "int"), Field("on", "boolean"), Field("price", "decimal"), Field("at", "datetime"), Field("changed", "datetime"), Field("by", "string")), audit={"modified_date": "changed", "created_by": "by"})


@pytest.fixture
def items(spark):
    ws = Engine(spark).workspace()
    ws.add(ITEM)
    repo = Repository(ws, "Item", user=lambda: "me")
    repo.saveAll([
        {"id": 1, "name": "Ab", "n": 3, "on": True, "price": Decimal("1.50"), "at": dt.datetime(2020, 1, 1)},
        {"id": 2, "name": None, "n": None, "on": None, "price": None, "at": None},
        {"id": 3, "name": "a\\b%", "n": 1, "on": False, "price": Decimal("2"), "at": dt.datetime(2021, 1, 1)},
        {"id": 4, "name": "abc", "n": 1, "on": True, "price": Decimal("1.5"), "at": dt.datetime(2022, 1, 1)},
    ])
    return repo


def ids(rows):
    return [r["id"] for r in rows]


@pytest.mark.parametrize(("method", "args", "want"), [
    ("findByName", [None], {2}), ("findByNameNot", ["abc"], {1, 2, 3}), ("findByNNot", [1], {1, 2}), ("findByNNotIn", [[1]], {1, 2}), ("findByNIn", [[]], set()), ("findByNIn", [None], set()),
    ("findByNameLike", ["a%"], {3, 4}), ("findByNameNotLike", ["a%"], {1, 2}), ("findByNameNotLike", [None], {1, 2, 3, 4}), ("findByNameLike", ["a\\b%"], {3}), ("findByNameContaining", [""], {1, 3, 4}),
    ("findByNameStartingWithIgnoreCase", ["AB"], {1, 4}), ("findByNameIgnoreCase", ["ABC"], {4}), ("findByOnTrue", [], {1, 4}), ("findByOnFalse", [], {3}), ("findByNIsNull", [], {2}),
    ("findByPrice", [Decimal("1.5")], {1, 4}), ("findByAtAfter", [dt.datetime(2020, 6, 1)], {3, 4}), ("findByAtBefore", [dt.datetime(2020, 6, 1)], {1}), ("findByNGreaterThan", [2147483647], set()), ("findByNBetween", [1, 2], {3, 4}),
    ("findByNotExists", None, None),
])
def test_predicates(items, method, args, want):
    if want is None:
        with pytest.raises(AttributeError):
            getattr(items, method)
    else:
        assert set(ids(getattr(items, method)(*args))) == want


def test_not_in_text_is_rewritten_not_complemented(items):
    assert set(ids(items.frame("select i from Item i where not (i.n > 1)").collect())) == {3, 4}
    assert set(ids(items.frame("select i from Item i where not (i.n = 1)").collect())) == {1, 2}


def test_null_order_and_ties(items):
    assert ids(items.findAllByOrderByNAsc()) == [3, 4, 1, 2]
    assert ids(items.findAllByOrderByNDesc()) == [2, 1, 4, 3]
    assert ids(items.findTop2ByOrderByNDesc()) == [2, 1]


def test_wrong_types_are_refused(items):
    for method, args in (("findByN", ["x"]), ("findByOnGreaterThan", [True]), ("findByNLike", ["1%"]), ("findByNIn", [[1, None]])):
        with pytest.raises((TypeError, ValueError)):
            getattr(items, method)(*args)


def test_saves_assign_ids_and_last_write_wins(items):
    saved = items.saveAll([{"name": "x"}, {"id": 0, "name": "y"}, {"id": 1, "name": "first"}, {"id": 1, "name": "last"}])
    assert [s["id"] for s in saved] == [5, 6, 1, 1]
    assert items.findById(1)["name"] == "last" and items.count() == 6
    assert items.findById(5)["by"] == "me" and items.findById(5)["changed"] is not None
    assert items.findById(None) is None and not items.existsById(99)


def test_updates_and_deletes_count(items):
    before = items.table
    assert items.execute("update Item i set i.name = 'z' where i.n = :n", n=1) == 2
    assert items.execute("delete from Item i where i.name <> 'z'") == 2
    assert set(ids(items.findAll())) == {3, 4} and before.count() == 4
    assert items.deleteByN(1) == 2 and items.count() == 0


def test_groups_keep_null_keys(items):
    items.returns = {"countByN": "map"}
    assert items.countByN() == {3: 1, None: 1, 1: 2}
    assert {k: len(v) for k, v in items.findAllGroupingByN().items()} == {3: 1, None: 1, 1: 2}


def test_converters_and_hooks(spark):
    import enum

    class Colour(enum.Enum):
        RED = 1

    ws = Engine(spark).workspace()
    ws.add(Entity("Paint", "id", (Field("id", "long"), Field("colour", "string"))))
    ws.converters.for_field("Paint", "colour", enum_names(Colour))

    class Paints(Repository):
        entity = "Paint"
        seen = []

        def pre_persist(self, row):
            self.seen.append("new")

        def pre_update(self, row):
            self.seen.append("old")

    repo = Paints(ws)
    repo.save({"id": 1, "colour": Colour.RED})
    repo.save({"id": 1, "colour": Colour.RED})
    assert repo.findByColour(Colour.RED)[0]["colour"] is Colour.RED and repo.seen == ["new", "old"]


def test_relations_to_non_ids_do_not_multiply(spark):
    ws = Engine(spark).workspace()
    account = Entity("Account", "id", (Field("id", "int"), Field("code", "int"), Field("name", "string")), (ToMany("bills", "Bill", "account"),))
    bill = Entity("Bill", "id", (Field("id", "long"), Field("ref", "string")), (ToOne("account", "Account", "account_code", "code"),))
    ws.add(account, spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (3, 8, "c")], "id int, code int, name string"))
    ws.add(bill, spark.createDataFrame([(1, "x", 7), (2, "y", 9), (3, "z", None)], "id long, ref string, account_code int"))
    bills = Repository(ws, "Bill")
    assert ids(bills.findByAccountNameIn(["a", "b"])) == [1]
    rows = bills.frame("select b.id as id, b.account.name as name from Bill b").collect()
    assert sorted((r["id"], r["name"]) for r in rows) == [(1, "a"), (2, None), (3, None)]
    assert sorted(ids(bills.frame("findByAccountNameOrRef", "a", "z").collect())) == [1, 3]
    sizes = {r["id"]: len(r["bills"]) for r in Repository(ws, "Account").hydrated("bills").collect()}
    assert sizes == {1: 1, 2: 1, 3: 0}


def test_batches_get_dense_ids(spark):
    ws = Engine(spark).workspace()
    ws.add(Entity("T", "id", (Field("id", "long"), Field("v", "long"))), spark.createDataFrame([(10, 0)], "id long, v long"))
    batch = spark.range(100).repartition(3).select(F.lit(None).cast("long").alias("id"), F.col("id").alias("v"))
    after = Repository(ws, "T").save_frame(batch)
    assert sorted(r["id"] for r in after.collect()) == list(range(10, 111))


def test_empty_structs_read_as_null(spark):
    df = spark.createDataFrame([(1, (None, None)), (2, (5, None))], "id int, e struct<a:int,b:int>")
    assert [r["e"] is None for r in null_if_empty(df, "e").orderBy("id").collect()] == [True, False]


def test_closed_workspaces_refuse(spark):
    engine = Engine(spark)
    ws = engine.workspace("w")
    engine.close("w")
    with pytest.raises(RuntimeError):
        ws.table("x")
    assert relquill.Workspace is type(engine.workspace("w"))


def test_streamed_upserts(spark, tmp_path):
    from relquill.streaming.upserts import upsert_stream

    ws = Engine(spark).workspace()
    ws.storage = str(tmp_path / "store")
    ws.add(Entity("T", "id", (Field("id", "long"), Field("v", "long"))), spark.createDataFrame([(1, 0), (2, 0)], "id long, v long"))
    spark.createDataFrame([(2, 5), (2, 6), (3, 7)], "id long, v long").write.parquet(str(tmp_path / "in"))
    stream = upsert_stream(Repository(ws, "T"), spark.readStream.schema("id long, v long").parquet(str(tmp_path / "in")), str(tmp_path / "cp"), order="v")
    stream.processAllAvailable()
    stream.stop()
    assert sorted(tuple(r) for r in ws.table("T").collect()) == [(1, 0), (2, 6), (3, 7)]


def test_plans(spark):
    ws = catalog.open_workspace(spark, SF)

    def plan(*a):
        return Repository(ws, "Order").frame(*a)._jdf.queryExecution().executedPlan().toString()

    assert "LeftSemi" in plan("findByCustomerMktsegment", "BUILDING")
    assert "ExistenceJoin" in plan("findByCustomerMktsegmentOrTotalGreaterThan", "BUILDING", 5)
    assert "TakeOrderedAndProject" in plan("findTop3ByStatusOrderByTotalDesc", "F")
    assert "StringStartsWith" in Repository(ws, "Customer").frame("findByNameStartingWith", "C")._jdf.queryExecution().executedPlan().toString()


def test_catalogue_against_sql(spark):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    bad = []
    for name, query in catalog.queries().items():
        df, sql = query(spark, SF), catalog.oracle_sql()[name]
        columns = sorted(df.columns)
        got = sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
        if got != sorted(con.sql(f"select {', '.join(columns)} from ({sql})").fetchall(), key=repr):
            bad.append(name)
    assert not bad


def test_ids_given_and_assigned_do_not_meet(items):
    assert items.save({"name": "a"})["id"] == 5
    items.save({"id": 6, "name": "given"})
    assert [r["id"] for r in items.saveAll([{"name": "b"}, {"id": 9, "name": "c"}, {"name": "d"}])] == [10, 9, 11]
    items.save_frame(items.table.limit(1).select(*[F.lit(20).cast("long").alias("id") if c == "id" else F.col(c) for c in items.table.columns]))
    assert items.save({"name": "e"})["id"] == 21 and items.count() == 11


def test_concurrent_saves_lose_nothing(items):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda k: items.save({"name": f"n{k}"})["id"], range(8)))
    assert sorted(got) == list(range(5, 13)) and items.count() == 12


def test_batches_with_rows_of_one_id_need_an_order(items):
    batch = items.table.filter("id < 3").unionByName(items.table.filter("id = 1"))
    with pytest.raises(ValueError, match="several rows of id 1"):
        items.save_frame(batch)
    assert items.save_frame(batch.withColumn("seq", F.monotonically_increasing_id()), order="seq").count() == 4


def test_results_that_a_query_cannot_have(spark):
    import dataclasses

    @dataclasses.dataclass
    class Pair:
        name: str
        n: str

    class Items(Repository):
        entity = "Item"
        queries = {"pairs": "select i.name as name, i.n as n from Item i", "named": "select i.name as name from Item i"}
        records = {"pairs": Pair, "named": Pair}
        returns = {"deleteByName": "list", "findByName": "void", "findByN": "map"}

    ws = Engine(spark).workspace()
    ws.add(ITEM)
    repo = Items(ws)
    with pytest.raises(TypeError, match="n is int"):
        repo.compile("pairs")
    for name in ("named", "deleteByName", "findByName", "findByN"):
        with pytest.raises(ValueError):
            repo.compile(name)
    with pytest.raises(ValueError):
        Entity("E", "id", (Field("id", "long"),), generation="uuid")


def test_objects_of_nested_dataclasses(spark):
    import dataclasses

    @dataclasses.dataclass
    class Address:
        city: str | None

    @dataclasses.dataclass
    class Person:
        id: int
        address: Address | None = None

    ws = Engine(spark).workspace()
    ws.add(Entity("Person", "id", (Field("id", "long"), Field("address.city", "string"))), spark.createDataFrame([(1, ("Ulm",)), (2, (None,))], "id long, address struct<city:string>"))
    repo = Repository(ws, "Person")
    repo.made_as = Person
    assert sorted(repo.findAll(), key=lambda p: p.id) == [Person(1, Address("Ulm")), Person(2, None)]


def test_objects_are_made_by_the_workers(spark, monkeypatch):
    """``each`` has the objects that a call has, converted and through the hook, and no row of the query goes to the driver."""
    import dataclasses

    from pyspark.sql.classic.dataframe import DataFrame

    from relquill.functions.values import Converter

    @dataclasses.dataclass
    class Person:
        id: int
        name: str | None = None

    class People(Repository):
        entity, made_as = "Person", Person

        def post_load(self, row):
            return row | {"name": f"{row['name']}!"}

    ws = Engine(spark).workspace()
    ws.add(Entity("Person", "id", (Field("id", "long"), Field("name", "string", converter=Converter(str.lower, lambda v: v and v.upper())))), spark.createDataFrame([(1, "ann"), (2, None), (3, "bob")], "id long, name string"))
    repo = People(ws)
    wanted = [(p.id, p.name) for p in repo.findByIdGreaterThanOrderByIdDesc(0)]
    assert wanted == [(3, "BOB!"), (2, "None!"), (1, "ANN!")]
    assert list(map(tuple, repo.each("findByIdGreaterThanOrderByIdDesc", lambda p: (p.id, p.name), "id long, name string", 0).collect())) == wanted
    for name in ("countByName", "deleteByName"):
        with pytest.raises(ValueError):
            repo.each(name, lambda p: (p,), "p string", "ann")

    with monkeypatch.context() as m:
        m.setattr(DataFrame, "collect", lambda self: pytest.fail("rows went to the driver"))
        objects = catalog.queries()["materialised_objects"](spark, SF)
    rows = spark.read.parquet(f"{SF}/orders.parquet").filter("o_orderstatus = 'P' and o_totalprice > 300000").select("o_orderkey", "o_orderstatus", "o_totalprice")
    assert sorted(map(tuple, objects.collect())) == sorted(map(tuple, rows.collect())) != []


def test_layouts_reach_the_files(spark, tmp_path):
    """Files of a range do not overlap, endings are sought as beginnings, and bloom filters are there."""
    import glob

    import pyarrow.parquet as pq

    from relquill.sources.workspace import HIDDEN, Workspace

    def written(entity, table):
        ws, path = Workspace(spark), str(tmp_path / entity.name)
        ws.add(entity, spark.read.parquet(f"{SF}/{table}.parquet"))
        ws.write_parquet(entity.name, path, files=4)
        back = Workspace(spark)
        back.read_parquet(entity, path)
        return Repository(back, entity.name), sorted(glob.glob(f"{path}/*.parquet"))

    def bounds(file, column):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.to_arrow_schema().names.index(column)
        return [(s.min, s.max) for s in (meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups))]

    repo, files = written(catalog.LAID_RANGE, "orders")
    spans = sorted(x for f in files for x in bounds(f, "o_totalprice"))
    assert len(files) == 4 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    repo, files = written(catalog.LAID_COMPOSITE, "orders")
    spans = sorted(x for f in files for x in bounds(f, "o_orderstatus"))
    assert len(files) == 4 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    repo, files = written(catalog.LAID_TEXT, "customer")
    df = repo.frame("findByNameEndingWith", "77")
    assert f"StringStartsWith({HIDDEN}c_name,77)" in df._jdf.queryExecution().executedPlan().toString() and df.columns == spark.read.parquet(f"{SF}/customer.parquet").columns
    repo.save({"custkey": 10**6, "name": "new 77"})
    assert 10**6 in [r["c_custkey"] for r in repo.findByNameEndingWith("77")]
    _, files = written(catalog.LAID_HASH, "orders")
    jvm = spark._jvm
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(files[0]), spark.sparkContext._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    blooms = {str(c.getPath()): reader.readBloomFilter(c) is not None for c in reader.getFooter().getBlocks()[0].getColumns()}
    reader.close()
    # a column of few values has a dictionary in its place, which prunes as well
    assert blooms["[o_orderkey]"] and not blooms["[o_totalprice]"]


def test_plans_without_needless_shuffles(spark):
    ws = catalog.open_workspace(spark, SF)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "Exchange" not in plan(Repository(ws, "Order").by_id(7))
    assert "Exchange" not in plan(Repository(ws, "Order").frame("findDistinctByStatus", "F"))


def test_shared_folder_is_qualified(spark):
    from relquill.sources.shared import qualified

    before = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
    assert qualified(spark, "/a/b") == "file:/a/b" and qualified(spark, "file:///a") == "file:/a" and before
