"""lexigrid.sources"""
