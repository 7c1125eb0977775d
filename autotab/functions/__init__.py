"""autotab.functions"""
