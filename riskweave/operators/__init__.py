"""Batch operators over identities and access events."""
