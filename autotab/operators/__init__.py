"""autotab.operators"""
