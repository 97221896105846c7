"""Readers by name; an unknown name is an error, never a silent default."""

from labelloom.sources import readers

READERS = {"dump": readers.recogniser_dumps, "scans": readers.stored_scans, "registry": readers.registry, "images": readers.images, "lines": readers.line_manifests}


def reader(name: str):
    if name not in READERS:
        raise ValueError(f"no reader {name!r}; there are {sorted(READERS)}")
    return READERS[name]
