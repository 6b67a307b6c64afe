"""Configuration of rules: layers, allow lists, thresholds. Values that results depend on, stated plainly."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Layers in order of precedence with their globs.
LAYERS = {
    "ui": ["*.vue", "*.tsx", "*.jsx", "*.component.ts"],
    "state": ["*/stores/*.ts", "*/composables/*.ts"],
    "client": ["*/api/*.ts", "*/services/*.ts", "*.service.ts"],
    "api": ["*/Api/*.cs", "*.Api/*.cs", "*/Controllers/*.cs", "*/Endpoints/*.cs", "*/controller/*.java", "*/web/*.java"],
    "application": ["*/Application/*.cs", "*.Application/*.cs", "*/service/*.java"],
    "domain": ["*/Domain/*.cs", "*.Domain/*.cs", "*.Core/*.cs", "*/domain/*.java", "*/model/*.java", "*/entity/*.java"],
    "infrastructure": ["*/Infrastructure/*.cs", "*.Infrastructure/*.cs", "*/Persistence/*.cs"],
}
#: What a layer may use. A layer that isn't named may use any; an empty list allows none.
ALLOW = {
    "ui": ["state", "client"],
    "state": ["client"],
    "client": ["http"],
    "api": ["application", "domain", "infrastructure"],
    "application": ["domain"],
    "domain": [],
    "infrastructure": ["application", "domain"],
}
SEVERITY = {"ARCH-001": "high", "ARCH-002": "medium", "ARCH-003": "medium", "ARCH-004": "low"}
GATE = {"min_coverage": 80, "max_critical": 0, "max_violations": 0, "max_cycles": 0}
#: Systems, verbs and framework namespaces of the security rules.
SENSITIVE = ("database", "storage", "identity", "email", "messaging", "cache")
MUTATING = ("POST", "PUT", "PATCH", "DELETE")
FRAMEWORKS = (
    "Microsoft.AspNetCore", "Microsoft.Identity", "Microsoft.IdentityModel", "Microsoft.Owin.Security", "org.springframework.security",
    "org.springframework.web", "jakarta.servlet", "javax.servlet", "jakarta.ws.rs", "javax.ws.rs",
)


@dataclass(frozen=True)
class Selector:
    """What a custom rule speaks of: all set fields must match the symbol or, for kind, tag and name, what holds it."""

    layer: str | None = None
    path: str | None = None
    kind: str | None = None
    tag: str | None = None
    name: str | None = None


@dataclass(frozen=True)
class Rule:
    """Forbids edges from a selection to a selection, a package or of a kind."""

    id: str
    source: Selector
    to: Selector | None = None
    packages: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    exceptions: Selector | None = None
    severity: str = "medium"


@dataclass(frozen=True)
class Architecture:
    layers: dict[str, list[str]] = field(default_factory=lambda: LAYERS)
    allow: dict[str, list[str]] = field(default_factory=lambda: ALLOW)
    rules: tuple[Rule, ...] = ()


def problems(a: Architecture, edge_kinds: set[str]) -> list[str]:
    """What is wrong with a configuration, in words; empty if nothing is."""
    out, seen = [], set()
    for layer, uses in a.allow.items():
        out += [f"allow.{layer}: no such layer"] * (layer not in a.layers)
        out += [f"allow.{layer}: {u} is no layer" for u in uses if u not in a.layers and u != "http"]
    for r in a.rules:
        out += [f"{r.id}: the id is taken"] * (r.id in seen or r.id in SEVERITY)
        seen.add(r.id)
        out += [f"{r.id}: from selects nothing"] * (r.source == Selector())
        out += [f"{r.id}: forbids nothing"] * (r.to is None and not r.packages and not r.kinds)
        out += [f"{r.id}: severity {r.severity}"] * (r.severity not in ("low", "medium", "high"))
        out += [f"{r.id}: no edge kind {k}" for k in r.kinds if k not in edge_kinds]
        out += [f"{r.id}: no layer {s.layer}" for s in (r.source, r.to, r.exceptions) if s and s.layer and s.layer not in a.layers]
    return out
