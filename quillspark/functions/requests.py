"""Checks of requests, policies and cursors, made before a plan is built."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from dataclasses import dataclass, field


class InvalidRequest(ValueError):
    """A request that is refused; the message names the rule."""


def _require(condition: bool, rule: str) -> None:
    if not condition:
        raise InvalidRequest(rule)


def search_input(query: str, sources: list[str], types: list[str], page: int, longest: int = 4096) -> None:
    """A query with text of bounded size, up to 16 distinct sources, up to 8 types, a page of 1 to 100."""
    _require(bool(query.strip()) and len(query.encode()) <= longest, "query")
    _require(len(sources) <= 16 and len(set(sources)) == len(sources), "sources")
    _require(len(types) <= 8, "types")
    _require(1 <= page <= 100, "page")


def remote_input(text: str, facets: list[tuple[str, object]], window: int, allowed: list[str]) -> None:
    """Text of 1 to 4096 bytes, up to 16 distinct allowed facets with scalar values, a window of 1 to 100."""
    _require(0 < len(text.encode()) <= 4096, "text")
    names = [n for n, _ in facets]
    _require(len(names) <= 16 and len(set(names)) == len(names) and set(names) <= set(allowed), "facets")
    _require(all(isinstance(v, (str, int, float, bool)) for _, v in facets), "facet value")
    _require(1 <= window <= 100, "window")


def vector_query(text: str, window: int, activated: bool) -> str:
    """The trimmed text of 1 to 2048 bytes, for sources that opted in."""
    _require(activated, "activation")
    trimmed = text.strip()
    _require(0 < len(trimmed.encode()) <= 2048, "text")
    _require(1 <= window <= 100, "window")
    return trimmed


def page_size(value: int) -> int:
    _require(1 <= value <= 200, "page size")
    return value


def graph_plan(seeds: list[str], hops: list, namespaces: list[str], max_seeds: int, max_hops: int, max_relations: int) -> None:
    """Something of everything, positive budgets, and no more seeds or hops than they allow."""
    _require(bool(seeds) and bool(hops) and bool(namespaces), "empty plan")
    _require(min(max_seeds, max_hops, max_relations) > 0, "budget")
    _require(len(seeds) <= max_seeds and len(hops) <= max_hops, "over budget")


def delivery_policy(batch: int, in_flight: int, lease_ms: int, renew_ms: int, backoff_min_ms: int, backoff_max_ms: int) -> None:
    _require(1 <= batch <= 32 and 1 <= in_flight <= 8, "size")
    _require(1000 <= lease_ms <= 120_000 and 0 < renew_ms * 3 < lease_ms, "lease")
    _require(1000 <= backoff_min_ms <= backoff_max_ms <= 300_000, "backoff")


def encode_cursor(kind: str, sort: str, filters: dict, principal: str, revision: int, position: list) -> str:
    """A keyset position bound to what it was made for."""
    body = {"v": 1, "binding": _binding(kind, sort, filters, principal, revision), "position": position}
    return base64.urlsafe_b64encode(json.dumps(body, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(token: str, kind: str, sort: str, filters: dict, principal: str, revision: int) -> list:
    try:
        body = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
    except ValueError:
        raise InvalidRequest("cursor") from None
    _require(isinstance(body, dict) and body.get("v") == 1 and body.get("binding") == _binding(kind, sort, filters, principal, revision), "cursor")
    return body["position"]


def _binding(kind: str, sort: str, filters: dict, principal: str, revision: int) -> str:
    return hashlib.sha256(json.dumps([kind, sort, filters, principal, revision], sort_keys=True).encode()).hexdigest()


@dataclass
class CursorStore:
    """One-shot handles with an absolute and an idle limit in seconds, bound to whom they were issued for."""

    absolute: float = 300.0
    idle: float = 60.0
    held: dict[str, tuple] = field(default_factory=dict)

    def issue(self, binding: tuple, position: int, now: float, began: float | None = None) -> str:
        handle = uuid.uuid4().hex
        self.held[handle] = (binding, position, now if began is None else began, now)
        return handle

    def consume(self, handle: str, binding: tuple, now: float) -> tuple[int, float]:
        """Position and first issue; the handle is gone whatever comes of it."""
        _require(handle in self.held, "cursor")
        bound, position, began, touched = self.held.pop(handle)
        _require(bound == binding and now - began <= self.absolute and now - touched <= self.idle, "cursor")
        return position, began
