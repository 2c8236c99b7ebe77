"""Tenancy: who asks, and what that does to events and queries."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import Unauthorized


@dataclass(frozen=True)
class Scope:
    """The caller. A caller without a tenant is the platform's and may name any tenant."""

    app_id: str = ""
    tenant_id: str = ""
    user_id: str = ""
    ip: str = ""

    def merged(self, **fields: str) -> Scope:
        """Sets the fields given, except empty ones."""
        return replace(self, **{k: v for k, v in fields.items() if v})

    def required(self) -> Scope:
        if not self.app_id:
            raise Unauthorized("a scope needs an app_id")
        return self

    def fill(self, events: DataFrame) -> DataFrame:
        """Fills the scope columns of events where they are unset."""
        filled = {k: F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit(v)) if k in events.columns else F.lit(v) for k, v in vars(self).items()}
        return events.withColumns(filled)

    def apply(self, query: Any) -> Any:
        """A query's application is filled if unset; its tenant is always the caller's, if the caller has one."""
        return replace(query, app_id=query.app_id or self.app_id, tenant_id=self.tenant_id or query.tenant_id)

    def owns(self, by_tenant: bool = True) -> Column:
        """The rows of this scope."""
        found = F.lit(True)
        if self.app_id:
            found = found & (F.col("app_id") == self.app_id)
        if by_tenant and self.tenant_id:
            found = found & (F.col("tenant_id") == self.tenant_id)
        return found


def client_ip(forwarded: Column, real_ip: Column, remote: Column) -> Column:
    """The client's address: the first forwarded one as written, else the real-IP header, else the peer without its port."""
    return F.when(forwarded != "", F.substring_index(forwarded, ",", 1)).when(real_ip != "", real_ip).otherwise(F.regexp_replace(remote, ":[^:]*$", ""))
