"""Bindings of the engine's relations to the driver tables, the registered queries and their SQL checks."""


def registered() -> dict:
    """All registered queries: name -> (query, SQL check or None)."""
    from scholarmesh.plans import catalogue, registry, search, texts

    out: dict = {}
    for module in (search, catalogue, registry, texts):
        clash = out.keys() & module.ENTRIES.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(module.ENTRIES)
    return out
