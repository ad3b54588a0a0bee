"""A Spark-native dataset profiler: any DataFrame in, one report out."""

__version__ = "0.1.0"

_PUBLIC = {"profile": "profiler", "profile_excel": "profiler", "Profiler": "profiler", "ProfileReport": "profiler", "ProfileConfig": "config", "Report": "report", "registry": "operators.metrics", "Metric": "operators.metrics"}
__all__ = [*_PUBLIC, "__version__"]


def __getattr__(name: str):
    """Public names load with their module, so that importing the package costs nothing."""
    if name in _PUBLIC:
        from importlib import import_module

        return getattr(import_module(f".{_PUBLIC[name]}", __name__), name)
    raise AttributeError(name)
