"""loomgraph.plans"""
