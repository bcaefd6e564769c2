"""Reading recordings, decoding their messages, and writing results."""
