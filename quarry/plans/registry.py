"""Named components: chunkers, retrievers, augmentations, parsers, scorers; own ones join by decorator."""

from __future__ import annotations

import importlib
import inspect
import logging
from collections.abc import Callable

from quarry.operators import augment, chunkers, retrieve
from quarry.sources import parsers

log = logging.getLogger(__name__)


class Registry:
    def __init__(self, kind: str, builtin: dict | None = None):
        self.kind, self._own, self.aliases = kind, dict(builtin or {}), {}

    def register(self, name: str, config_aliases: dict[str, str] | None = None) -> Callable:
        """Decorator; config_aliases maps keys of a configuration to parameters, which must exist."""

        def add(component):
            known = set(inspect.signature(component).parameters)
            for key, parameter in (config_aliases or {}).items():
                if parameter not in known:
                    raise ValueError(f"{self.kind} {name!r} has no parameter {parameter!r} for {key!r}")
            self._own[name] = component
            self.aliases[name] = dict(config_aliases or {})
            return component

        return add

    def get(self, name: str, default: str | None = None):
        if name in self._own:
            return self._own[name]
        if default is None:
            raise ValueError(f"no {self.kind} {name!r}; there are {', '.join(sorted(self._own))}")
        log.warning("no %s %r; %r is used", self.kind, name, default)
        return self._own[default]

    def components(self) -> dict:
        return dict(self._own)

    def names(self) -> list[str]:
        return sorted(self._own)

    def settings(self, name: str, conf: dict, **inject) -> dict:
        """The parts of a flat configuration that the component takes, by parameter name or alias, and what is injected."""
        known = inspect.signature(self.get(name)).parameters
        out = {k: v for k, v in conf.items() if k in known and known[k].default is not inspect.Parameter.empty}
        out |= {p: conf[k] for k, p in self.aliases.get(name, {}).items() if k in conf}
        return out | {k: v for k, v in inject.items() if k in known}


chunker = Registry("chunker", chunkers.CHUNKERS)
chunker.aliases["semantic"] = {"semantic_threshold": "threshold"}
retriever = Registry("retriever", {"keyword": retrieve.keyword, "bm25": retrieve.bm25, "semantic": retrieve.semantic_or_keyword, "hybrid": retrieve.hybrid})
augmentation = Registry("augmentation", {"in_memory": augment.in_memory, "on_the_fly": augment.on_the_fly})
parser = Registry("parser", parsers.PARSERS)


def load_custom(modules: list[str]) -> list[str]:
    """Imports modules that register components; one that fails warns."""
    done = []
    for name in modules:
        try:
            importlib.import_module(name)
            done.append(name)
        except Exception as e:
            log.warning("module %s: %s", name, e)
    return done
