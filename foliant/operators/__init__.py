"""Operators over blocks, nodes, anchors, results and logs."""
