"""All kinds of objects by name."""

from __future__ import annotations

from clusterlens.plans import network, pods, storage, workloads
from clusterlens.plans.common import Kind


def kinds() -> dict[str, Kind]:
    """The 17 kinds.  Adding one means adding a :class:`Kind` here and a schema for it."""
    known = [pods.kind(), *workloads.kinds(), *network.kinds(), *storage.kinds()]
    return {kind.name: kind for kind in known}
