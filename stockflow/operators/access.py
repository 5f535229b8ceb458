"""Users and permissions.

users(id, name, email, role, ...); permissions(user_id, module, can_view,
can_create, can_edit, can_delete). Module and view lists are fixed values
of the data model; they are expanded with ``explode`` of a literal array,
not with a cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.functions.scalars import norm_email

# Modules, and the navigation views with the module each needs.
MODULES = ["Sales", "Purchase", "Manufacturing", "Product", "BoM", "Audit", "User"]
VIEWS = [("dashboard", "Dashboard", "Dashboard"), ("sales", "Sale Orders", "Sales"),
         ("purchase", "Purchase Orders", "Purchase"),
         ("manufacturing", "Manufacturing Orders", "Manufacturing"),
         ("boms", "Bills of Materials", "BoM"), ("products", "Products", "Product"),
         ("stock", "Stock Ledger", "Product"), ("audit", "Audit Logs", "Audit"),
         ("users", "User Management", "User")]
PUBLIC_USER_FIELDS = ["id", "name", "email", "role", "position", "mobile_number", "address"]
LEVELS = ["can_view", "can_create", "can_edit", "can_delete"]


def public_users(users: DataFrame) -> DataFrame:
    """B1: allow-list of user fields; credentials never leave."""
    return users.select(*[c for c in PUBLIC_USER_FIELDS if c in users.columns])


def _modules_col(modules: Sequence[str]) -> Column:
    return F.explode(F.array(*[F.lit(m) for m in modules]))


def can(users: DataFrame, permissions: DataFrame, action: str = "view",
        modules: Sequence[str] = MODULES) -> DataFrame:
    """Per (user, module): Admin -> true; no permission row -> false;
    otherwise the level for the action is not 'None' (Limited passes)."""
    level = f"can_{action}"
    um = users.select(F.col("id").alias("user_id"), "role", _modules_col(modules).alias("module"))
    p = permissions.select("user_id", "module", F.col(level).alias("_lvl"))
    return (um.join(p, ["user_id", "module"], "left")
            .select("user_id", "module",
                    (F.col("role") == "Admin")
                    .alias("_adm"), "_lvl")
            .select("user_id", "module",
                    (F.coalesce(F.col("_adm"), F.lit(False))
                     | F.coalesce(F.col("_lvl") != "None", F.lit(False))).alias("allowed")))


def visible_views(users: DataFrame, permissions: DataFrame) -> DataFrame:
    """Navigation views a user sees: Dashboard always, others when the
    view's module passes B7 for 'view'."""
    allowed = can(users, permissions, "view")
    v = F.explode(F.array(*[F.struct(F.lit(i).alias("view_id"), F.lit(lbl).alias("label"),
                                     F.lit(mod).alias("module")) for i, lbl, mod in VIEWS]))
    uv = users.select(F.col("id").alias("user_id"), v.alias("v")).select("user_id", "v.*")
    return (uv.join(allowed, ["user_id", "module"], "left")
            .filter((F.col("module") == "Dashboard") | F.coalesce(F.col("allowed"), F.lit(False)))
            .select("user_id", "view_id", "label"))


def admin_permissions(users: DataFrame, modules: Sequence[str] = MODULES) -> DataFrame:
    """C8: 'Full' on every module for each Admin."""
    return (users.filter(F.col("role") == "Admin")
            .select(F.col("id").alias("user_id"), _modules_col(modules).alias("module"))
            .select("user_id", "module", *[F.lit("Full").alias(c) for c in LEVELS]))


def permission_matrix(allowed: DataFrame, modules: Sequence[str] = MODULES) -> DataFrame:
    """Seven rows per user from allowed(user_id, modules array<string>):
    allowed -> Full / Full / Full / Limited, else None; delete on Audit is
    always None."""
    a = allowed.select("user_id", "modules", _modules_col(modules).alias("module"))
    ok = F.coalesce(F.array_contains("modules", F.col("module")), F.lit(False))
    lvl = F.when(ok, "Full").otherwise("None")
    return a.select("user_id", "module", lvl.alias("can_view"), lvl.alias("can_create"),
                    lvl.alias("can_edit"),
                    F.when(F.col("module") == "Audit", "None").when(ok, "Limited").otherwise("None")
                    .alias("can_delete"))


def permissions_for_email(users: DataFrame, email: str, modules: Sequence[str],
                          levels: Sequence[str]) -> DataFrame:
    """One permission row per module for the user(s) with this e-mail
    (case-insensitive), with the given four levels."""
    u = users.filter(norm_email("email") == email.strip().lower())
    return (u.select(F.col("id").alias("user_id"), _modules_col(modules).alias("module"))
            .select("user_id", "module", *[F.lit(v).alias(c) for c, v in zip(LEVELS, levels)]))


def permissions_by_user(permissions: DataFrame) -> DataFrame:
    """Permission rows grouped per user: user_id, chunk_no, permissions
    (one chunk unless a user has more rows than ``summaries.CHUNK``)."""
    from stockflow.operators.summaries import collect_present
    return collect_present(permissions, "user_id", ["module", *[c for c in LEVELS if c in permissions.columns]],
                           "permissions", present="module")


def duplicate_emails(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming users whose e-mail already exists, any case."""
    e = existing.select(F.lower(F.col("email")).alias("_e"))
    return incoming.withColumn("_e", F.lower(F.col("email"))).join(e, "_e", "left_semi").drop("_e")


def exists_in(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a match in ``other`` (semi join)."""
    return rows.join(other.select(*keys), list(keys), "left_semi")


def not_in(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a match in ``other`` (anti join)."""
    return rows.join(other.select(*keys), list(keys), "left_anti")


def access_denied(requests: DataFrame, users: DataFrame, permissions: DataFrame,
                  action: str = "view") -> DataFrame:
    """K5: requests(user_id, module, ...) that B7 refuses; an unknown user is
    refused too. Joins against one row per (user, module)."""
    allowed = can(users, permissions, action).filter(F.col("allowed")).select("user_id", "module")
    return requests.join(allowed, ["user_id", "module"], "left_anti")
