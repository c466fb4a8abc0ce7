"""Decoders that carry state from one batch of a stream to the next."""
