"""A small driver-side cache of rendered tiles for viewers; the engine itself persists tables instead."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Hashable


class TileCache:
    """The most recently used tiles, up to a number of them. A key that is put again keeps its first tile until invalidated."""

    def __init__(self, size: int = 256):
        self._size, self._tiles = size, OrderedDict()

    def __len__(self) -> int:
        return len(self._tiles)

    def get(self, key: Hashable):
        if key in self._tiles:
            self._tiles.move_to_end(key)
        return self._tiles.get(key)

    def put(self, key: Hashable, tile) -> None:
        self._tiles.setdefault(key, tile)
        self._tiles.move_to_end(key)
        while len(self._tiles) > self._size:
            self._tiles.popitem(last=False)

    def invalidate(self) -> None:
        self._tiles.clear()
