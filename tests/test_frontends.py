"""Names and texts to logical queries: no Spark."""

import pytest

from relquill.catalog import CUSTOMER, LABEL, NATION, ORDER, PART, REGION
from relquill.plans.ir import And, Compare, Literal, Or, Param
from relquill.plans.names import parse_name
from relquill.plans.schema import Entity, Field, Model, ToMany, ToOne
from relquill.plans.text import parse_text

MODEL = Model(CUSTOMER, ORDER, NATION, REGION, PART, LABEL)


def name(text, entity=ORDER, **kw):
    return parse_name(MODEL, entity, text, **kw)


def test_limits_orders_and_slots():
    q = name("findTop3ByStatusAndTotalBetweenOrderByPriorityAscAndTotalDesc")
    assert q.limit == 3 and [(o.path, o.descending) for o in q.order] == [("priority", False), ("total", True)]
    assert q.where == And((Compare("status", "EQ", (Param(0),)), Compare("total", "BETWEEN", (Param(1), Param(2)))))
    assert name("findFirstByStatus").limit == 1 and name("findDistinctByStatus").distinct


def test_and_binds_tighter_than_or():
    q = name("findByStatusOrPriorityAndTotalGreaterThan")
    assert q.where == Or((Compare("status", "EQ", (Param(0),)), And((Compare("priority", "EQ", (Param(1),)), Compare("total", "GT", (Param(2),))))))


@pytest.mark.parametrize(("spelled", "op"), [("IsNotNull", "NOT_NULL"), ("IsNull", "IS_NULL"), ("IsLike", "LIKE"), ("NotIn", "NOT_IN"), ("IsNot", "NE"), ("NotEqual", "NE"), ("After", "AFTER"), ("LessThanEqual", "LTE"), ("NotEndingWith", "NOT_ENDING_WITH")])
def test_spellings(spelled, op):
    assert name(f"findByStatus{spelled}").where.op == op


def test_operators_inside_properties_do_not_split_them():
    invoice = Entity("Invoice", "id", (Field("id", "long"), Field("invoiceNumber", "string"), Field("notes", "string"), Field("orderBy", "string")))
    model = Model(invoice)
    assert parse_name(model, invoice, "findByInvoiceNumberAndNotesNot").where.parts[0].path == "invoiceNumber"
    assert parse_name(model, invoice, "findByNotesIsNull").where == Compare("notes", "IS_NULL")


def test_nested_paths():
    assert name("findByCustomerNationRegionName").where.path == "customer.nation.region.name"
    assert name("findByCustomer_Mktsegment").where.path == "customer.mktsegment"
    assert name("findByMarkQuality", LABEL).where.path == "mark.quality"


def test_grouping():
    q = name("findAllGroupingByStatusAndPriorityAsSet")
    assert q.group == "SET" and q.group_by == ("status", "priority")
    assert name("countByStatus", returns="map").group == "COUNT"
    assert name("countByTotalGroupingByStatus").group_by == ("status",)


@pytest.mark.parametrize("bad", ["findBy", "findByStatusAnd", "findByStatusOrderBy", "findByNothing", "fetchByStatus", "findAllGroupingByStatusOrderByTotal", "findByStatusGreaterThanLessThan"])
def test_refused_names(bad):
    with pytest.raises(ValueError):
        name(bad)


def test_text_tree_and_not():
    q = parse_text(MODEL, "select o from Order o where not (o.status = 'a''b' or o.total > 1.5) and o.priority in ('x', :p)")
    assert q.where.parts[0] == And((Compare("status", "NE", (Literal("a'b"),)), Compare("total", "LTE", q.where.parts[0].parts[1].args)))
    assert q.where.parts[1].op == "IN"


def test_text_aliases_and_left_joins():
    q = parse_text(MODEL, "select o.total as t, c.name from Order o left join fetch o.customer c where c.mktsegment = ?1 order by c.name desc, o.total")
    assert q.projection == (("t", "total"), ("name", "customer.name")) and q.left == {"customer"} and len(q.order) == 2


@pytest.mark.parametrize("bad", [
    "select count(*) from Order o", "select o.customer from Order o", "select c.orders.total as t from Customer c", "select o from Order o right join o.customer c",
    "update Order o set o.orderkey = 1", "update Order o set o.customer.name = 'x'", "select o from Order o where not (o.total between 1 and 2)",
    "select count(o) from Order o group by o.status having not count(o) > 1", "select o from Order o group by o.status having count(o) > 1", "select o from Order o where", "select o.total, o.total from Order o",
])
def test_refused_texts(bad):
    with pytest.raises(ValueError):
        parse_text(MODEL, bad)


def test_schema_checks():
    with pytest.raises(ValueError):
        Entity("X", "nope", (Field("id", "long"),))
    with pytest.raises(ValueError):
        Entity("X", "id", (Field("id", "long"),), (ToOne("id", "Y", "y"),))
    with pytest.raises(ValueError):
        Model(CUSTOMER).path(CUSTOMER, "orders.total")
    assert ToMany("a", "B", "c").as_set is False
