"""Caches of a process that stay behind when a function travels to another one."""


class Cache(dict):
    def __reduce__(self):
        return Cache, ()
