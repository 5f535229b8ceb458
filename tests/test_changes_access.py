"""Hand-checked cases for change feeds, numbering and access rules."""

from decimal import Decimal as D

from stockflow.operators import access, changes


def test_users_merge_last_saved_wins_and_appends(spark):
    base = spark.createDataFrame([(1, "Ann", "ann@example.test", "User"), (2, "Bob", "bob@example.test", "User")],
                                 "id long, name string, email string, role string")
    saved = spark.createDataFrame([(1, 1, "Ann A", "ANN@example.test", "Manager"),
                                   (2, 1, "Ann B", "ann@Example.test", "Admin"),
                                   (3, 9, "Cy", "cy@example.test", "User")],
                                  "pos long, id long, name string, email string, role string")
    got = {r.id: (r.name, r.email, r.role) for r in changes.load_users_merge(base, saved).collect()}
    assert got == {1: ("Ann B", "ann@Example.test", "Admin"), 2: ("Bob", "bob@example.test", "User"),
                   9: ("Cy", "cy@example.test", "User")}


def test_permissions_merge_base_wins_then_first_saved(spark):
    base = spark.createDataFrame([(1, "Sales", "Full")], "user_id long, module string, can_view string")
    saved = spark.createDataFrame([(1, 1, "Sales", "None"), (2, 1, "BoM", "Limited"), (3, 1, "BoM", "Full")],
                                  "pos long, user_id long, module string, can_view string")
    got = {(r.user_id, r.module): r.can_view for r in changes.load_permissions_merge(base, saved).collect()}
    assert got == {(1, "Sales"): "Full", (1, "BoM"): "Limited"}


def test_final_status_last_command_wins_and_delivery_status_precedes(spark):
    orders = spark.createDataFrame([(1, "Draft"), (2, "Confirmed"), (3, None)], "id long, status string")
    cmds = spark.createDataFrame([(1, 1, "confirm", None), (1, 2, "cancel", None), (1, 3, "confirm", None),
                                  (2, 1, "deliver", "Partially Delivered")],
                                 "order_id long, seq long, command string, status string")
    got = {r.order_id: r.status for r in changes.final_status(orders, cmds).collect()}
    assert got == {1: "Confirmed", 2: "Partially Delivered", 3: "Draft"}


def test_illegal_transitions_sequence(spark):
    orders = spark.createDataFrame([(1, "Draft")], "id long, status string")
    cmds = spark.createDataFrame([(1, 1, "start"), (1, 2, "confirm"), (1, 3, "produce"), (1, 4, "confirm")],
                                 "order_id long, seq long, command string")
    got = [(r.seq, r.old_status) for r in changes.illegal_transitions(orders, cmds).orderBy("seq").collect()]
    # start from Draft is not offered; after it the order is In Progress, so confirm is not offered either;
    # produce from In Progress is; confirm from Done is not.
    assert got == [(1, "Draft"), (2, "In Progress"), (4, "Done")]


def test_compact_changes_with_base(spark):
    base = spark.createDataFrame([(1, D("5.000"), "b1"), (2, D("7.000"), "b2")], "k long, v decimal(14,3), label string")
    feed = spark.createDataFrame([(1, 10, "update", None, "u1"), (2, 11, "delete", None, None),
                                  (3, 12, "update", D("1.000"), "x"), (3, 13, "create", D("2.000"), "c3")],
                                 "k long, seq long, op string, v decimal(14,3), label string")
    got = {r.k: (r.v, r.label, r.last_seq) for r in
           changes.compact_changes(feed, "k", keep_cols=["v"], overlay_cols=["label"], base=base).collect()}
    assert got == {1: (D("5.000"), "u1", 10), 3: (D("2.000"), "c3", 13)}
    rejects = {r.seq for r in changes.feed_rejects(feed, "k", base=base).collect()}
    assert rejects == {12}


def test_can_and_visible_views(spark):
    users = spark.createDataFrame([(1, "Admin"), (2, "User"), (3, "User")], "id long, role string")
    perms = spark.createDataFrame([(2, "Sales", "Limited"), (2, "Audit", "None"), (3, "Product", "Optional")],
                                  "user_id long, module string, can_view string")
    allowed = {(r.user_id, r.module) for r in access.can(users, perms).filter("allowed").collect()}
    assert (1, "User") in allowed and (2, "Sales") in allowed and (3, "Product") in allowed
    assert (2, "Audit") not in allowed and (3, "Sales") not in allowed
    views = {(r.user_id, r.view_id) for r in access.visible_views(users, perms).collect()}
    assert {(3, "dashboard"), (3, "products"), (3, "stock")} == {v for v in views if v[0] == 3}
    assert len([v for v in views if v[0] == 1]) == 9


def test_permission_matrix_audit_delete_none(spark):
    allowed = spark.createDataFrame([(5, ["Sales", "Audit"])], "user_id long, modules array<string>")
    got = {r.module: (r.can_view, r.can_delete) for r in access.permission_matrix(allowed).collect()}
    assert got["Sales"] == ("Full", "Limited") and got["Audit"] == ("Full", "None")
    assert got["BoM"] == ("None", "None") and len(got) == 7


def test_patch_rejects_unknown_keys(spark):
    base = spark.createDataFrame([(1, "a")], "id long, name string")
    patches = spark.createDataFrame([(1, 1, {"name": "b"}), (2, 2, {"name": "c"})],
                                    "id long, seq long, patch map<string,string>")
    assert [(r.id, r.seq) for r in changes.patch_rejects(base, patches, "id").collect()] == [(2, 2)]
    assert [r.name for r in changes.overlay_patch(base, patches, "id").collect()] == ["b"]
