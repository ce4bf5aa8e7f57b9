"""Proposals of predicates by a language model: a pluggable callable, none by default, with validation, retries and a cache."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from veridelta.operators.predicate import Predicate, PredicateRejected, described, validate, validate_semantics

#: Attempts, and hosted prices per 1000 tokens in and out.
ATTEMPTS, PRICE_IN, PRICE_OUT = 3, 0.003, 0.015


@dataclass(frozen=True)
class ProposerConfig:
    """Which backend proposes; the key is never shown."""

    backend: str = "none"
    model: str | None = None
    api_key: str | None = None

    def updated(self, **changes) -> ProposerConfig:
        """With the changes that are not None."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})

    def public(self) -> dict:
        return {"backend": self.backend, "model": self.model, "has_api_key": bool(self.api_key)}


def hosted_cost(tokens_in: int, tokens_out: int) -> float:
    return tokens_in / 1000 * PRICE_IN + tokens_out / 1000 * PRICE_OUT


def topic_key(topic: dict, context: dict, kind: str = "topic") -> str:
    """24 hex digits that name a proposal by all that it depends on."""
    return hashlib.sha256(json.dumps([kind, topic, context], sort_keys=True, default=str).encode()).hexdigest()[:24]


def topic_prompt(topic: dict, context: dict, allowed: dict[str, list[str]]) -> str:
    return json.dumps({"task": "Propose one causal predicate that explains the movement, as JSON.", "topic": topic, "movement": context, "dimensions": allowed, "schema": described()}, default=str)


def challenge_prompt(survivor: dict, context: dict, allowed: dict[str, list[str]]) -> str:
    return json.dumps({"task": "Propose one rival predicate that would explain the movement instead, as JSON.", "survivor": survivor, "movement": context, "dimensions": allowed, "schema": described()}, default=str)


def propose(ask: Callable[[str], tuple[str, int, int]] | None, prompt: str, allowed: dict[str, list[str]], attempts: int = ATTEMPTS, extra: Callable[[Predicate], None] | None = None) -> dict:
    """{predicate, reason, tokens_in, tokens_out, latency_ms, attempts}: the first answer that is valid and fits the data.

    ``ask`` returns (answer, tokens in, tokens out); a rejection is told to it in the next attempt. Without a backend
    there is no predicate, and the reason says so. ``extra`` may reject what is otherwise valid.
    """
    if ask is None:
        return {"predicate": None, "reason": "no backend", "tokens_in": 0, "tokens_out": 0, "latency_ms": 0.0, "attempts": 0}
    start, used, text, reason = time.perf_counter(), [0, 0], prompt, ""
    for k in range(1, attempts + 1):
        answer, a, b = ask(text)
        used = [used[0] + a, used[1] + b]
        try:
            found = validate(json.loads(answer))
            validate_semantics(found, allowed)
            if extra is not None:
                extra(found)
            return {"predicate": found.nested(), "reason": "", "tokens_in": used[0], "tokens_out": used[1], "latency_ms": (time.perf_counter() - start) * 1000, "attempts": k}
        except (PredicateRejected, ValueError) as e:
            reason = str(e)
            text = f"{prompt}\nThe last answer was rejected: {reason}"
    return {"predicate": None, "reason": reason, "tokens_in": used[0], "tokens_out": used[1], "latency_ms": (time.perf_counter() - start) * 1000, "attempts": attempts}


def propose_for_topic(ledger, ask, topic: dict, context: dict, allowed: dict[str, list[str]], config: ProposerConfig = ProposerConfig()) -> dict:
    """A topic's proposal, from the ledger's cache if it was made before; every call that is made is in the telemetry."""
    key = topic_key(topic, context)
    hit = ledger.cache_get("predicate", key)
    if hit is not None:
        return json.loads(hit) | {"cached": True, "tokens_in": 0, "tokens_out": 0, "latency_ms": 0.0}
    made = propose(ask, topic_prompt(topic, context, allowed), allowed)
    if made["predicate"] is not None:
        ledger.cache_put("predicate", key, config.model or config.backend, json.dumps(made, default=str))
    if ask is not None:
        with ledger.span(str(int(time.time())), "predicate_proposal", True, config.model, made["tokens_in"], made["tokens_out"], hosted_cost(made["tokens_in"], made["tokens_out"]), made["latency_ms"]):
            pass
    return made | {"cached": False}
