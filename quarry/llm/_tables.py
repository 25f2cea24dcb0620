"""Tables that operators keep between their passes, in the folder the cluster shares."""

from quarry.tables import kept, new_path, partitions, removed, shared_dir

__all__ = ["kept", "new_path", "partitions", "removed", "shared_dir"]
