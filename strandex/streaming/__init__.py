"""Streaming forms of operators that allow one."""
