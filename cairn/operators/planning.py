"""What is settled on the driver before a search: tenants, embedding models, stores, and who may search what."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Base:
    """A knowledge base."""

    id: str
    tenant_id: int = 0
    kind: str = "document"
    model: str = ""
    store: str = ""
    engine: str = "table"
    vectors: bool = True
    keywords: bool = True

    def retrievers(self) -> tuple[str, ...]:
        return tuple(n for n, on in (("vector", self.vectors), ("keywords", self.keywords)) if on)


def tenant(explicit: int | None, own: int, bases: dict[str, Base], asked: Iterable[str], primary: str = "") -> int:
    """The explicit tenant, else one's own, else the only one of the bases asked; 0 where it is not clear."""
    if explicit is not None:
        return explicit
    if own:
        return own
    ids = [b for b in asked if b] or ([primary] if primary else [])
    found = {bases[b].tenant_id for b in ids if b in bases and bases[b].tenant_id}
    return found.pop() if len(found) == 1 else 0


def one_model(bases: Iterable[Base], resolve: Callable[[Base], str] = lambda b: b.model) -> str:
    """The embedding model that all bases share; bases without one do not count. ValueError if there are several."""
    models = {m for b in bases if (m := resolve(b))}
    if len(models) > 1:
        raise ValueError("selected knowledge bases use different embedding models; multi-KB search requires every knowledge base to share a single embedding model")
    return models.pop() if models else ""


def by_store(bases: Iterable[Base]) -> dict[tuple[str, int, str], list[Base]]:
    """Bases that one search of a store answers: by store, tenant and engine, in the order they come."""
    out: dict[tuple[str, int, str], list[Base]] = defaultdict(list)
    for b in bases:
        out[b.store, b.tenant_id, b.engine].append(b)
    return dict(out)


@dataclass(frozen=True)
class Params:
    """One retrieval: by ``retriever`` over some bases."""

    retriever: str
    bases: tuple[str, ...]
    k: int
    threshold: float
    kind: str = "document"


def retrievals(bases: Iterable[Base], k: int, vector_threshold: float = 0.0, keyword_threshold: float = 0.0, no_vectors: bool = False, no_keywords: bool = False) -> list[Params]:
    """Vector retrieval of document bases, then of FAQ bases; keyword retrieval of all but FAQ bases."""
    bases, out = list(bases), []
    if not no_vectors:
        for kind in ("document", "faq"):
            if ids := tuple(b.id for b in bases if b.vectors and (b.kind == "faq") == (kind == "faq")):
                out.append(Params("vector", ids, k, vector_threshold, kind))
    if not no_keywords and (ids := tuple(b.id for b in bases if b.keywords and b.kind != "faq")):
        out.append(Params("keywords", ids, k, keyword_threshold))
    return out


@dataclass(frozen=True)
class Target:
    """Part of what a caller may search; no documents means the whole base."""

    base: str
    tenant_id: int = 0
    documents: tuple[str, ...] = ()


@dataclass
class Scope:
    bases: list[str] = field(default_factory=list)
    documents: list[str] = field(default_factory=list)


def targets(scope: Scope, bases: dict[str, Base], home: dict[str, str], tenant_id: int = 0) -> list[Target]:
    """What a scope allows; nothing where it names nothing. home: the base of each known document.

    Named documents count in their own base, and only if that base is named too where any is; unknown ones are looked
    for in every named base. Bases without any retriever are left out.
    """
    of = lambda b: bases[b].tenant_id if b in bases and bases[b].tenant_id else tenant_id
    found: list[Target] = []
    if scope.documents:
        own: dict[str, list[str]] = defaultdict(list)
        for d in scope.documents:
            own[home.get(d, "")].append(d)
        lost = tuple(own.pop("", ()))
        found = [Target(b, of(b), tuple(ds)) for b, ds in own.items() if not scope.bases or b in scope.bases]
        found += [Target(b, of(b), lost) for b in scope.bases if lost]
    else:
        found = [Target(b, of(b)) for b in scope.bases]
    return [t for t in found if t.base not in bases or bases[t.base].retrievers()]


def scope_rows(found: list[Target]) -> list[tuple[int, str, str | None]]:
    """Targets as rows (tenant_id, kb_id, knowledge_id) of a scope table."""
    return [(t.tenant_id, t.base, d) for t in found for d in (t.documents or (None,))]
