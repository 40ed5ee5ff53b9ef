"""Written tables in the shared folder; see ``cairn.scratch``."""

from cairn.scratch import Scratch, shared_folder

__all__ = ["Scratch", "shared_folder"]
