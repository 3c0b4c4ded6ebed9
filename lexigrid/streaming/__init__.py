"""lexigrid.streaming"""
