"""lexigrid.functions"""
