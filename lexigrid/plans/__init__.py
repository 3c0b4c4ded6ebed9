"""lexigrid.plans"""
