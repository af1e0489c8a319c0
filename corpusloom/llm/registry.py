"""The registry of the queries of this subpackage."""

from corpusloom.runtime import Registry

LLM = Registry()
