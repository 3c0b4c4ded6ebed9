"""lexigrid.operators"""
