"""Containers and what lies in them: disk images, file systems, archives, and their readers and writers."""
