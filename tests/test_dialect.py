import pytest

from brookwell.dialect import Call, Condition, DialectError, Join, Literal, Name, Selector, nodes, parse


def test_select_in_full():
    s = parse("SELECT a, b AS x, COUNT(*), sum(c) as s, 5, 'q' FROM t LEFT JOIN u ON t.a <> u.b cross join v WHERE a = 1 AND b like 'x%' OR c >= -2.5 GROUP BY a, b ORDER BY x DESC LIMIT 3 OFFSET 4;")
    assert [x.item for x in s.selectors] == [Name("a"), Name("b"), Call("COUNT", "*"), Call("sum", "c"), Literal(5), Literal("q")]
    assert s.joins == (Join("left", "u", "t.a", "!=", "u.b"), Join("cross", "v"))
    assert s.where == ((Condition("a", "=", Literal(1)), Condition("b", "like", Literal("x%"))), (Condition("c", ">=", Literal(-2.5)),))
    assert (s.group_by, s.order_by, s.descending, s.limit, s.offset) == (("a", "b"), "x", True, 3, 4)


@pytest.mark.parametrize("kind", ["inner", "left", "right", "full", "cross"])
@pytest.mark.parametrize("op", ["=", "!=", ">", "<", ">=", "<="])
def test_joins(kind, op):
    assert parse(f"select * from a {kind} join b on a.x {op} b.y").joins == (Join(kind, "b", "a.x", op, "b.y"),)


def test_table_aliases():
    s = parse("select a.x, b.x as y from t as a left join t as b on a.x = b.z cross join u as c where c.k = 1")
    assert (s.table, s.alias) == ("t", "a") and s.joins == (Join("left", "t", "a.x", "=", "b.z", "b"), Join("cross", "u", alias="c"))
    assert parse("find t as q where q.x = 1").alias == "q" and parse("select * from t").alias is None


def test_short_surface():
    assert parse("select ships").short and parse("select ships").table == "ships"
    assert parse("select ships where tons > 3").selectors == (Selector(None),)
    assert parse('find ships where port = "Bergen"').where == ((Condition("port", "=", Literal("Bergen")),),)
    assert parse("delete ships where hull = 1") == parse("delete from ships where hull = 1")
    made = parse('insert ships { hull: 71, port: "Riga", papers: { tons: 1200.5, flags: ["LV", "EE"], owner: null } }')
    assert made.columns == ("hull", "port", "papers") and made.rows == ((71, "Riga", {"tons": 1200.5, "flags": ["LV", "EE"], "owner": None}),)
    assert parse("create table t { id: int, s: string }") == parse("create table t (id int, s string)")


def test_values():
    s = parse("insert into t (a, b, c, d, e, f) values (null, TRUE, false, pine, -3, +2.5), (1, 2, 3, 4, 5, '--no')")
    assert s.rows == ((None, True, False, "pine", -3, 2.5), (1, 2, 3, 4, 5, "--no"))


def test_create_table_in_full():
    s = parse("create table e (id int primary key auto_increment not null unique, n varchar(10) default 'x', l enum('a','b'), d int references p(id) on delete set null on update cascade check (d > 0), t timestamp default CURRENT_TIMESTAMP, constraint c check (l in ('a', 'b')))")
    id_, n, enum, d, t = s.columns
    assert id_.primary_key and id_.auto_increment and id_.not_null and id_.unique
    assert n.parameters == (10,) and n.default == Literal("x") and enum.parameters == ("a", "b")
    assert d.references == nodes.Reference("p", "id", "set null", "cascade") and d.check == Condition("d", ">", Literal(0))
    assert t.default == Name("CURRENT_TIMESTAMP") and s.checks == (("c", Condition("l", "in", (Literal("a"), Literal("b")))),)


def test_other_statements():
    assert parse("create index i on t (c)") == nodes.CreateIndex("i", "t", "c")
    assert parse("DROP INDEX i;") == nodes.DropIndex("i") and parse("drop table t") == nodes.DropTable("t")
    assert parse("show tables;") == nodes.ShowTables() and parse("Describe t") == nodes.Describe("t")
    assert parse("update t set a = 1, b = null where c = x -- end").assignments == (("a", 1), ("b", None))


def test_keywords_are_not_reserved():
    s = parse("select limit, order from where where like like 'a'")
    assert s.table == "where" and s.where == ((Condition("like", "like", Literal("a")),),)


@pytest.mark.parametrize("text", ["", "select", "select from", "select a b from t", "select * from t where", "select * from t where a", "select * from t where (a = 1)", "select * from t limit -1", "select a, b where c = 1", "insert into t (a) values (1, 2)", "create table t", "create table t (a)", "select * from t; select 1", "select 'x", "update t set", "merge into t", "select * from a join b", "select * from t order by"])
def test_rejected(text):
    with pytest.raises(DialectError):
        parse(text)
