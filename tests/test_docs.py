"""Documentation items on hand-made comments."""

from graphloom.operators import docs as D

SCHEMA = "id string, kind string, name string, type_name string, language string, returns string, parameters array<string>, params int, doc string, required array<string>, derived map<string,string>"


def test_items(spark):
    m = lambda x: f"<member>{x}</member>"
    need = ["summary", "param"]

    def node(i, doc, name="Move", returns=None, parameters=("int from: Int", "to?: Place"), params=2, kind="method", required=need, derived=None):
        names = [p if ":" in p else f"{p}: T" for p in parameters] if parameters is not None else None
        return (i, kind, name, "StockKeeper", "csharp", returns, names, params, doc, required, derived)

    nodes = [
        node("full", m('<summary>Takes goods from\n one <see cref="T:A.B.Shelf`1"/> to another</summary><param name="FROM">a</param><param name="to">b</param>'), parameters=("[body] from: Int", "to: Int"), returns="int"),
        node("partial", m('<summary>Takes goods elsewhere at once</summary><param name="from">a</param><param name="to"> </param>'), parameters=("from", "to")),
        node("counted", m('<param name="x">a</param><param name="y">b</param>'), parameters=("{a, b}: T",), derived={"summary": "calls x"}),
        node("todo", m("<summary>TODO: write</summary>"), params=0, parameters=()),
        node("short", m('<summary>Two words</summary><returns>x</returns><param name="gone">y</param>'), parameters=("a",)),
        node("echo", m("<summary>Gets the stock keeper move</summary>"), parameters=(), params=0),
        node("none", m('<inheritdoc source="none"/>'), parameters=()),
        node("some", m("<inheritdoc/>"), parameters=("a",)),
        node("iface", m('<inheritdoc source="interface"/>'), parameters=()),
        node("ref", m('<inheritdoc source="none" cref="X"/>'), parameters=()),
        node("broken", "<member><summary>a</member>", derived={"summary": "d", "param": "p"}),
        node("taken", None, parameters=("from", "to")),
        node("bare", None),
        node("nodoc", None, kind="class", required=None),
    ]
    implements = [("taken", "nodoc", 0), ("taken", "partial", 1), ("taken", "todo", 2), ("iface", "nodoc", 0), ("iface", "lost", 1)]
    got = {r.id: r for r in D.documentation_items(spark.createDataFrame(nodes, SCHEMA), spark.createDataFrame(implements, "from_id string, to_id string, ord int")).collect()}
    assert len(got) == len(nodes)
    status = {k: (r.status, r.missing, [f.flag for f in r.flags]) for k, r in got.items()}
    assert status == {
        "full": ("documented", [], []), "partial": ("partial", ["param"], []), "counted": ("documented", [], []), "todo": ("documented", [], ["placeholder"]),
        "short": ("partial", ["param"], ["param-drift", "returns-on-void", "placeholder"]), "echo": ("documented", [], ["echo"]), "none": ("partial", ["summary"], ["empty-inheritdoc"]),
        "some": ("documented", [], []), "iface": ("partial", ["summary"], ["empty-inheritdoc"]), "ref": ("documented", [], []), "broken": ("documented", [], []),
        "taken": ("partial", ["param"], []), "bare": ("undocumented", need, []), "nodoc": ("documented", [], []),
    }
    assert got["full"].sections["summary"] == ("written", "Takes goods from one `Shelf<T>` to another") and got["full"].sections["param"].text == "2 documented"
    assert got["counted"].sections == {"summary": ("derived", "calls x"), "param": ("written", "2 documented")} and got["some"].sections["param"].text == "inherited"
    assert got["iface"].flags[0].detail == "`<inheritdoc/>` from `nodoc`, which has no docs" and got["short"].flags[0].detail == "documents parameter `gone`, which doesn't exist"
