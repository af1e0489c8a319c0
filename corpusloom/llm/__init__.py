"""Operators for language-model training data. Nothing outside of this subpackage imports it."""

import importlib
import pkgutil

from corpusloom.llm.registry import LLM as LLM

for _module in pkgutil.iter_modules(__path__, __name__ + "."):
    importlib.import_module(_module.name)
