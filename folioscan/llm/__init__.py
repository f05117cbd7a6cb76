"""Training-data operators (near copies, wrong decodings, splitting, vector neighbours, scan repair, look-alikes, leaks, mixing, shared spans)."""
